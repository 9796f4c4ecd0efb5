import re
import string

import numpy as np
import pytest

SPACE = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return SPACE.findall(text or "")


@pytest.fixture(scope="session")
def corpus(spark):
    """A small corpus with every awkward case: nulls, blanks, repeated rows, near copies, shared
    passages, a long text, repeated ids, non-ASCII words, and columns with clashing names."""
    rng = np.random.default_rng(7)
    lexicon = ["".join(rng.choice(list(string.ascii_lowercase + "éß"), rng.integers(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(lexicon, n))
    base, passage = prose(200).split(), prose(60)
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join([*base[:190], "changed", *base[191:]]))]
    rows += [(3, prose(80) + "\n" + passage + "\t" + prose(70)), (4, passage + " " + prose(50)), (5, prose(30) + "  " + passage)]
    rows += [(6, None), (7, ""), (8, " \n\t "), (9, "one two"), (10, "one two"), (11, "x " * 300), (12, prose(3000))]
    rows += [(13, prose(120)), (13, prose(120)), (14, prose(90)), (14, rows[0][1]), (None, prose(60)), (15, prose(60).upper() + "!! | # $"), (16, "a\na\nb\n\na\n" + prose(60))]
    rows += [(20 + i, " ".join([*base[: 10 * i], *prose(4).split(), *base[10 * i + 4 :]])) for i in range(12)]
    rows += [(rows[3][0], rows[3][1])]
    data = [(i, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), k, k, k, "x") for k, (i, t) in enumerate(rows)]
    # columns whose names the operators use inside
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, fp int, lo int, rank int, before string").repartition(3)


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.where("false")
