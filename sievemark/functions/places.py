"""Column expressions for coordinates, postal codes and state names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.text import cleaned, decimal_number
from sievemark.policy import Policy

# State names, and unambiguous other spellings by their normalised form.
STATES = (
    "Andaman and Nicobar Islands", "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chandigarh", "Chhattisgarh",
    "Dadra and Nagar Haveli and Daman and Diu", "Delhi", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jammu and Kashmir",
    "Jharkhand", "Karnataka", "Kerala", "Ladakh", "Lakshadweep", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya",
    "Mizoram", "Nagaland", "Odisha", "Puducherry", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura",
    "Uttar Pradesh", "Uttarakhand", "West Bengal",
)
ALIASES = {
    "orissa": "Odisha", "uttaranchal": "Uttarakhand", "uttranchal": "Uttarakhand", "uk": "Uttarakhand", "up": "Uttar Pradesh", "u p": "Uttar Pradesh",
    "uttarpradesh": "Uttar Pradesh", "uttar prades h": "Uttar Pradesh", "mp": "Madhya Pradesh", "m p": "Madhya Pradesh", "madhyapradesh": "Madhya Pradesh",
    "madhya": "Madhya Pradesh", "mh": "Maharashtra", "ms": "Maharashtra", "maharastra": "Maharashtra", "gj": "Gujarat", "br": "Bihar", "cg": "Chhattisgarh",
    "chattisgarh": "Chhattisgarh", "ts": "Telangana", "telengana": "Telangana", "dl": "Delhi", "new delhi": "Delhi", "nct": "Delhi", "nct delhi": "Delhi",
    "nct of delhi": "Delhi", "delhi ncr": "Delhi", "ncr delhi": "Delhi", "east delhi": "Delhi", "west delhi": "Delhi", "south delhi": "Delhi",
    "north west delhi": "Delhi", "south east delhi area": "Delhi", "tamilnadu": "Tamil Nadu", "pondicherry": "Puducherry", "u t of puducherry": "Puducherry",
    "kashmir": "Jammu and Kashmir", "srinagar kashmir": "Jammu and Kashmir", "jammu j and k": "Jammu and Kashmir", "j and k": "Jammu and Kashmir",
    "the dadra and nagar haveli and daman and diu": "Dadra and Nagar Haveli and Daman and Diu", "dadra and nagar haveli": "Dadra and Nagar Haveli and Daman and Diu",
    "daman and diu": "Dadra and Nagar Haveli and Daman and Diu",
}


def position_status(y: Column, x: Column, missing: Column, policy: Policy = Policy()) -> Column:
    """What is to be said of a position: missing (no text at all), unparseable, out_of_range or ok."""
    outside = ((y == 0) & (x == 0)) | ~y.between(*policy.latitudes) | ~x.between(*policy.longitudes)
    return F.when(missing, "missing").when(y.isNull() | x.isNull(), "unparseable").when(outside, "out_of_range").otherwise("ok")


def coordinates(lat: Column, lon: Column, policy: Policy = Policy()) -> Column:
    """struct(lat, lon, status); values out of range are kept beside their status."""

    def status(v: Column) -> Column:
        y, x = v["y"], v["x"]
        name = position_status(y, x, v["missing"], policy)
        both = y.isNotNull() & x.isNotNull()
        return F.struct(F.when(both, y).alias("lat"), F.when(both, x).alias("lon"), name.alias("status"))

    # each text is read once, however often its number is asked for
    values = F.struct(decimal_number(lat).alias("y"), decimal_number(lon).alias("x"), (cleaned(lat).isNull() & cleaned(lon).isNull()).alias("missing"))
    return F.element_at(F.transform(F.array(values), status), 1)


def postal_code(c: Column) -> Column:
    """Six digits, the first not zero, that stand alone once spaces are gone."""
    text = F.regexp_replace(cleaned(c), r"(?U)\s+", "")
    return F.nullif(F.regexp_extract(text, r"(?<!\d)([1-9]\d{5})(?!\d)", 1), F.lit(""))


def state_key(c: Column) -> Column:
    key = F.replace(F.lower(cleaned(c)), F.lit("&"), F.lit(" and "))
    key = F.regexp_replace(key, r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(key, r"(?U)\s+", " "))


def _key_of(name: str) -> str:
    return name.lower()


def state_names(spark: SparkSession, states: tuple[str, ...] = STATES, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """The dimension of known keys: key, state, method. Replaceable for other countries."""
    rows = [(_key_of(s), s, "exact") for s in states] + [(k, v, "alias") for k, v in aliases.items()]
    return spark.createDataFrame(rows, "state_key string, state string, state_method string")


def with_state(df: DataFrame, source: str, state: str, method: str, states: tuple[str, ...] = STATES, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Adds the canonical name of the state in ``source`` and how it was found: exact, alias, suffix
    (the text ends with a state's name; the first in list order) or none. Cities are not guessed."""
    names = state_names(df.sparkSession, states, aliases)
    keyed = df.withColumn("_key", state_key(F.col(source)))
    # the dimension has a few dozen rows, whatever the data
    joined = keyed.join(F.broadcast(names.withColumnsRenamed({"state_key": "_k", "state": "_s", "state_method": "_m"})), F.col("_key") == F.col("_k"), "left")
    ends = F.array(*(F.struct(F.lit(" " + _key_of(x)).alias("end"), F.lit(x).alias("name")) for x in states))
    suffix = F.get(F.filter(ends, lambda x: F.endswith(F.col("_key"), x["end"])), F.lit(0))["name"]
    found = F.coalesce(F.col("_s"), suffix)
    how = F.when(F.col("_s").isNotNull(), F.col("_m")).when(suffix.isNotNull(), "suffix").otherwise("none")
    return joined.withColumns({state: found, method: how}).drop("_key", "_k", "_s", "_m")
