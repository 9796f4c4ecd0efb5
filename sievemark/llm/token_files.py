"""Token-id files: texts as ids of a public tokenizer, entropy-coded by an adaptive context-mixing
range coder.

A file is a Parquet table of segments in ascending doc_id order. A segment holds whole documents:
their ids' ends and a payload of blocks. Every block is coded by itself, with its own models from
scratch, and carries the number of its ids and the CRC-32 of them, checked when it is read; so a
damaged block is noticed and costs no other.

The coder. The ids that last followed the two ids before (order 2) and the one before (order 1) are
predicted, each with a confidence from its recent hits; order 0 is an adaptive distribution over
all ids: those that the block had lately, by how often, and all others by their length in bits and
the three bits after the first. What is coded is one mixture of the three: the weights of the
predictions are learnt for each pair of confidences, the rest is order 0's. A range coder of 48 bits
with carries codes an id in one step, and the lower bits of an id that is new to its block in another.
The weights and order 0 are counted anew after a fixed number of ids, seldom as a block grows long;
what order 1 and order 2 predict changes with every id.

All blocks of several segments are coded side by side: position by position, one array operation
for all blocks. Tokenizing looks each distinct word up once while there is room: the tokenizer sees
no further than white space, so a text's ids are its words' ids. Where the tokenizer splits and
lower-cases as `WordIds.SPLITS` says, a comma or the like at a word's end and a capital at its
beginning make no word of their own.

Defined results: a null or empty text is its end id alone; very long texts make longer segments;
repeated rows and ties are written each for itself, ordered by doc_id, then text; a null doc_id
comes first; an empty table gives empty files; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.shared import partitions, running_totals, sized, stored
from sievemark.llm.wordscan import WORD_BYTES, Words, text_chunks

BLOCK, SEGMENT = 4096, 1 << 19
LANES = 2048  # blocks that are coded side by side, at most
MAGIC = 0x53544F4D
HEAD = struct.Struct("<IHHIII")  # magic, bits of an id, 0, ids, crc32 of the ids, bytes of code
FULL, WORD16 = 1 << 48, 1 << 32
TOP = 16  # bits of the mixed distribution
SPAN = 11
TOTAL = 1 << SPAN  # of the order-0 frequencies
RECENT, BINS = 512, 128  # order 0: ids of the block by their last bits, and bins for all others
SYMBOLS = RECENT + BINS
SLOTS1, SLOTS2 = 256, 512
#: After so many ids of a block the weights and order 0 are counted anew, and after every further LATER.
FRESH, LATER = frozenset((24, 64, 128, 256, 512)), 1024
#: An id outside the recent ones counts so many times as much as a bin at the start; the bins together as many ids of the block.
SEEN, OUTSIDE = 10, 200
#: Of 16 predictions, so many are taken as right to begin with, by the confidence: nothing known, new, right once, right twice or more.
FIRST2, FIRST1 = np.array([0.0, 2, 8, 13]), np.array([0.0, 1.5, 5, 9])


def binned(ids: np.ndarray) -> np.ndarray:
    """Ids that are new to a block are seen as their length in bits and the three bits after the first."""
    left = np.maximum(np.frexp(ids.astype("float64"))[1] - 4, 0).astype("int64")
    return np.where(ids < 8, ids, (left + 1) * 8 + ((ids >> left) & 7))


#: Of each bin: the bits below, and its first id. Of each id its bin.
LEFT_OF = np.maximum(np.arange(BINS) // 8 - 1, 0)
BASE_OF = np.where(np.arange(BINS) < 8, np.arange(BINS), (8 + np.arange(BINS) % 8) << LEFT_OF)
BIN_OF = binned(np.arange(1 << 18)).astype("int16")


class Models:
    """The state of all blocks side by side, the same for the coder and the decoder.

    Order 1 and order 2 each predict one id with a confidence (0 to 3, 0 where there is none); order 0
    is a distribution over all ids. Their mixture is what is coded: the weights of the two predictions
    are learnt for each pair of confidences, the rest is order 0's. An id and its confidence stand in
    one number, and so do a symbol's id and the bounds of its order-0 part.
    """

    def __init__(self, lanes: int, longest: int, decoding: bool):
        self.lane, self.decoding = np.arange(lanes, dtype="int64"), decoding
        self.lane1, self.lane2, self.lane16, self.lane_symbol, self.lane_point = (self.lane * x for x in (SLOTS1, SLOTS2, 16, SYMBOLS, TOTAL))
        self.table1, self.table2 = np.full(lanes * SLOTS1, -4, "int32"), np.full(lanes * SLOTS2, -4, "int32")
        self.at1, self.at2, self.before = self.lane1, self.lane2, np.zeros(lanes, "int64")
        self.tried, self.hits2 = np.full((lanes, 16), 16.0), np.repeat(FIRST2, 4) + np.zeros((lanes, 1))
        self.hits1 = np.tile(FIRST1, 4) * (1 - self.hits2 / 16)
        self.recent, self.recent_n = np.full((lanes, RECENT), -1, "int32"), np.zeros((lanes, RECENT), "int32")
        self.bin_n = np.ones((lanes, BINS), "int32")
        self.ids = np.zeros((longest, lanes), "int32")
        #: Of the steps since the last count: the pair of confidences and, in the last two bits, the order that was right.
        self.code, self.since = np.zeros((LATER, lanes), "int8"), 0

    def count(self, t: int, active: np.ndarray) -> None:
        """The weights and the order-0 frequencies, from the ids before place t. Of ids with the same
        last bits the latest is the recent one; every bin keeps a frequency of one at least."""
        lanes = len(self.lane)
        if t > self.since:
            # block by block, so that what is counted for one stands close together
            code, ids = np.ascontiguousarray(self.code[: t - self.since].T), np.ascontiguousarray(self.ids[self.since : t].T)
            if active[t - 1] < lanes:
                code[self.lane[:, None] >= active[self.since : t]] = 3
            found = np.bincount((code + (self.lane * 64)[:, None]).ravel(), minlength=lanes * 64).reshape(lanes, 16, 4)
            self.hits1 += found[:, :, 1]
            self.hits2 += found[:, :, 2]
            self.tried += found[:, :, :3].sum(axis=2)
            literal = (code & 3) == 0
            ids, each = ids[literal], np.count_nonzero(literal, axis=1)
            key = np.repeat(self.lane * RECENT, each) + (ids & (RECENT - 1))
            before, flat = self.recent.copy(), self.recent.ravel()
            new = flat[key] != ids
            flat[key] = ids
            self.recent_n[self.recent != before] = 0
            self.recent_n += np.bincount(key[flat[key] == ids], minlength=lanes * RECENT).astype("int32").reshape(lanes, RECENT)
            self.bin_n += SEEN * np.bincount(np.repeat(self.lane * BINS, each)[new] + BIN_OF[ids[new]], minlength=lanes * BINS).astype("int32").reshape(lanes, BINS)
            self.since = t
        # what is left for order 0 never falls below its total
        most = (1 << TOP) - TOTAL - 4
        b2 = 1 + (most * self.hits2 / self.tried).astype("int64")
        self.b2, self.b1 = b2.ravel(), (b2 + 1 + (most * self.hits1 / self.tried).astype("int64")).ravel()
        freq = np.empty((lanes, SYMBOLS), "int32")
        freq[:, :RECENT] = self.recent_n * ((TOTAL - BINS) * 64 // (self.recent_n.sum(axis=1, keepdims=True, dtype="int32") + OUTSIDE)) >> 6
        rest = TOTAL - BINS - freq[:, :RECENT].sum(axis=1, keepdims=True, dtype="int32")
        freq[:, RECENT:] = 1 + (self.bin_n * (rest * 256 // self.bin_n.sum(axis=1, keepdims=True, dtype="int32")) >> 8)
        freq[self.lane, RECENT + freq[:, RECENT:].argmax(axis=1)] += TOTAL - freq.sum(axis=1)
        end = np.cumsum(freq, axis=1, dtype="int32")
        packed = (((end - freq) << 13) | end).astype("int64")
        packed[:, :RECENT] |= np.where(freq[:, :RECENT] > 0, self.recent, -1).astype("int64") << 26
        self.packed = packed.ravel()
        if self.decoding:
            self.symbol_at = np.repeat(np.tile(np.arange(SYMBOLS, dtype="int16"), lanes), freq.ravel())

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """For the first n blocks: both predictions, and where the mixture's second and third part begin."""
        e1, e2 = self.table1.take(self.at1[:n]), self.table2.take(self.at2[:n])
        self.sure1, self.sure2 = e1 & 3, e2 & 3
        self.pair = (self.sure2 << 2) + self.sure1
        at = self.lane16[:n] + self.pair
        return e1 >> 2, e2 >> 2, self.b2.take(at), self.b1.take(at)

    def learn(self, t: int, n: int, now: np.ndarray, ok1: np.ndarray, ok2: np.ndarray) -> None:
        """ok1: order 1 was right, whether or not order 2 was too."""
        right = ok1.astype("int8")
        np.putmask(right, ok2, 2)
        self.code[t - self.since, :n] = (self.pair << 2) + right
        fresh = (now << 2) + 1
        self.table1[self.at1[:n]] = fresh + np.minimum(self.sure1, 2) * ok1
        self.table2[self.at2[:n]] = fresh + np.minimum(self.sure2, 2) * ok2
        now = now.astype("int64")
        h = now * 40503
        self.at1 = self.lane1[:n] + ((h >> 7) & (SLOTS1 - 1))
        self.at2 = self.lane2[:n] + (((h + self.before[:n]) >> 9) & (SLOTS2 - 1))
        self.before = now * 60493


def _counted(t: int) -> bool:
    return t == 0 or t in FRESH or t % LATER == 0


def _side_by_side(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(blocks, longest first; for each position, how many of them are that long) of up to LANES blocks."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    for mine in np.array_split(order, -(-len(order) // LANES)) if len(order) else ():
        yield mine, np.searchsorted(-lengths[mine], -np.arange(int(lengths[mine[0]])), side="left")


def encode_blocks(ids: np.ndarray, lengths: np.ndarray, bits: int = 16) -> list[bytes]:
    """The blocks, laid end to end, each as header and code."""
    begin = np.cumsum(lengths) - lengths
    done: list[bytes] = [b""] * len(lengths)
    for mine, active in _side_by_side(lengths):
        for i, body in zip(mine.tolist(), _encoded(ids, begin[mine], active)):
            own = ids[begin[i] : begin[i] + lengths[i]].astype("<u4").tobytes()
            done[i] = HEAD.pack(MAGIC, bits, 0, int(lengths[i]), zlib.crc32(own), len(body)) + body
    return done


def _encoded(ids: np.ndarray, begin: np.ndarray, active: np.ndarray) -> list[bytes]:
    n, longest = len(begin), len(active)
    models = Models(n, longest, False)
    for k, at in enumerate(begin.tolist()):
        own = ids[at : at + longest]
        models.ids[: len(own), k] = own
    cap = longest * 5 // 8 + 64  # the first word takes carries only
    flat, used = np.zeros(n * cap, "int32"), np.arange(n) * cap + 1
    low, width = np.zeros(n, "int64"), np.full(n, FULL - 1, "int64")
    for t, m in enumerate(active.tolist()):
        if _counted(t):
            models.count(t, active)
        if t % 8 == 0 and int((used - np.arange(n) * cap).max()) + 24 > cap:  # eight ids make 16 words at most
            flat, used = np.pad(flat.reshape(n, cap), ((0, 0), (0, cap))).ravel(), used + np.arange(n) * cap
            cap *= 2
        now = models.ids[t, :m]
        p1, p2, b2, b1 = models.predict(m)
        ok1, ok2 = p1 == now, p2 == now
        packed = models.packed.take(models.lane_symbol[:m] + (now & (RECENT - 1)))
        new = (((packed >> 26).astype("int32") != now) & ~(ok1 | ok2)).nonzero()[0]
        fresh = now[new].astype("int64")
        bins = BIN_OF[fresh].astype("int64")
        packed[new] = models.packed[models.lane_symbol[new] + RECENT + bins]
        rest = (1 << TOP) - b1
        start, end = b1 + ((((packed >> 13) & 8191) * rest) >> SPAN), b1 + (((packed & 8191) * rest) >> SPAN)
        np.putmask(start, ok1, b2)
        np.putmask(end, ok1, b1)
        np.putmask(start, ok2, 0)
        np.putmask(end, ok2, b2)
        r = width[:m] >> TOP
        lo, w = _given_out(flat, used[:m], low[:m] + r * start, r * (end - start))
        if len(new):
            left, place = LEFT_OF[bins], used[new]
            one = w[new] >> left
            lo[new], w[new] = _given_out(flat, place, lo[new] + one * (fresh & ((1 << left) - 1)), one)
            used[new] = place
        low[:m], width[:m] = lo, w
        models.learn(t, m, now, ok1, ok2)
    for down in (32, 16, 0):
        flat[used] = (low >> down) & 0xFFFF
        used += 1
    while len(over := (flat > 0xFFFF).nonzero()[0]):
        flat[over] &= 0xFFFF
        flat[over - 1] += 1
    words = flat.astype("<u2")
    return [words[k * cap + 1 : end].tobytes() for k, end in enumerate(used.tolist())]


def _given_out(flat: np.ndarray, used: np.ndarray, lo: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sixteen bits leave the blocks whose width has room for them; a carry is added to the word
    before, and handed on at the end. Returns what is left of lo and w; ``used`` moves on."""
    over = (lo >= FULL).nonzero()[0]
    if len(over):
        flat[used[over] - 1] += 1
        lo[over] -= FULL
    small = w < WORD16
    flat[used] = lo >> 32
    used += small
    shift = small * 16
    return (lo & ((FULL - 1) >> shift)) << shift, w << shift


def split_payload(payload: bytes) -> list[tuple[int, int, bytes, int]]:
    """(ids, crc32, code, bits of an id) of the blocks of a payload; raises ValueError where it isn't one."""
    out, at = [], 0
    while at < len(payload):
        magic, bits, _, n, crc, size = HEAD.unpack_from(payload, at)
        if magic != MAGIC or at + HEAD.size + size > len(payload):
            raise ValueError("not a block of token ids")
        out.append((n, crc, payload[at + HEAD.size : at + HEAD.size + size], bits))
        at += HEAD.size + size
    return out


def decode_blocks(blocks: list[tuple[int, int, bytes, int]]) -> np.ndarray:
    """The ids of the blocks, laid end to end; raises ValueError if a checksum is wrong."""
    lengths = np.array([b[0] for b in blocks], "int64")
    begin = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), "uint32")
    for mine, active in _side_by_side(lengths):
        found = np.ascontiguousarray(_decoded([blocks[i][2] for i in mine.tolist()], active).T).astype("<u4")
        for k, i in enumerate(mine.tolist()):
            own = found[k, : lengths[i]]
            if zlib.crc32(own.tobytes()) != blocks[i][1]:
                raise ValueError(f"block {i}: wrong checksum")
            out[begin[i] : begin[i] + lengths[i]] = own
    return out


def _decoded(bodies: list[bytes], active: np.ndarray) -> np.ndarray:
    """The ids: a row for each position, a column for each block. Numbers of 48 bits stand in doubles,
    which hold them exactly; their quotients have 16 bits before the point, so they are cut right."""
    n, longest = len(bodies), len(active)
    models = Models(n, longest, True)
    cap = max(map(len, bodies)) // 2 + 4
    code = np.zeros((n, cap), "float64")
    for k, body in enumerate(bodies):
        own = np.frombuffer(body, "<u2", len(body) // 2)
        code[k, : len(own)] = own
    flat, used = code.ravel(), np.arange(n) * cap
    last = used + cap - 1
    value = flat[used] * 2.0**32 + flat[used + 1] * 2.0**16 + flat[used + 2]
    used += 3
    width = np.full(n, FULL - 1.0)
    for t, m in enumerate(active.tolist()):
        if _counted(t):
            models.count(t, active)
        p1, p2, b2, b1 = models.predict(m)
        v, r = value[:m], np.floor(width[:m] * 2.0**-TOP)
        point = np.minimum(v / r, (1 << TOP) - 1).astype("int64")
        ok2, predicted = point < b2, point < b1
        rest = (1 << TOP) - b1
        # the symbol whose part holds the point: the last one that begins at it or before
        ahead = ((np.maximum(point - b1, 0) + 1) << SPAN) - 1
        symbol = models.symbol_at.take((ahead / rest).astype("int64") + models.lane_point[:m])
        packed = models.packed.take(models.lane_symbol[:m] + symbol)
        start, end = b1 + ((((packed >> 13) & 8191) * rest) >> SPAN), b1 + (((packed & 8191) * rest) >> SPAN)
        now = (packed >> 26).astype("int32")
        for x, one, two in ((start, b2, 0), (end, b1, b2), (now, p1, p2)):
            np.putmask(x, predicted, one)
            np.putmask(x, ok2, two)
        v, w = _taken_in(flat, used[:m], last[:m], v - r * start, r * (end - start))
        new = ((symbol >= RECENT) & ~predicted).nonzero()[0]
        if len(new):
            bins, place, own = symbol[new] - RECENT, used[new], v[new]
            size = 1 << LEFT_OF[bins]
            one = np.floor(w[new] / size)
            below = np.minimum(own / one, size - 1).astype("int64")
            v[new], w[new] = _taken_in(flat, place, last[new], own - one * below, one)
            used[new] = place
            now[new] = BASE_OF[bins] + below
        value[:m], width[:m] = v, w
        models.ids[t, :m] = now
        models.learn(t, m, now, p1 == now, ok2)
    return models.ids


def _taken_in(flat: np.ndarray, used: np.ndarray, last: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sixteen bits more for the blocks whose width has room for them."""
    small = w < WORD16
    more = small * 65535.0 + 1
    v = v * more + flat.take(used) * small
    used += small
    np.minimum(used, last, out=used)
    return v, w * more


class WordIds:
    """Ids of words, each distinct one tokenized once while there is room. Words are known by their
    bytes, not by a hash of them. When the room is full, the words seen since the last time make up
    the older half, from which those that come again are taken over; the rest is forgotten.

    A tokenizer that normalizes and splits as ``SPLITS`` says always takes a single mark of ``MARKS``
    after a letter or digit at a word's end by itself, and takes capitals as small letters; so words
    are known without the mark and with a small first letter. Words of small letters alone
    pass its normalizer and its pattern unchanged, so they are given to its model without these.
    """

    LIMIT = 3 << 25  # bytes of words and ids in each half
    SPLITS = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    )
    MARKS = b".,;:!?"
    #: Small letters of ASCII and Latin-1.
    PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
    MARK = np.isin(np.arange(256), list(MARKS))
    #: ASCII letters and digits, ASCII letters, capitals, and the second bytes of the letters of Latin-1.
    ASCII = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    LETTER, CAPITAL = ASCII & (np.arange(256) > 57), ASCII & (np.arange(256) > 57) & (np.arange(256) < 97)
    LATIN = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0) & ~np.isin(np.arange(256), (0x97, 0xB7))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(16, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        stated = json.loads(self.tokenizer.to_str())
        model = stated["model"]
        self.splits = (stated["normalizer"], stated["pre_tokenizer"]) == self.SPLITS and not stated["truncation"] and not stated["padding"]
        self.model = None
        if self.splits:
            # an added token might hold letters or marks only
            self.splits = all("<" in x["content"] and not x["normalized"] and not x["lstrip"] and not x["rstrip"] for x in stated["added_tokens"])
        if self.splits:
            if model["type"] == "BPE" and model["end_of_word_suffix"] and not model["unk_token"] and not model["dropout"]:
                self.model = Tokenizer.from_file(path)
                self.model.normalizer = normalizers.Sequence([])
                self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
                self.ends = np.zeros(1 << self.bits, bool)
                self.ends[[k for word, k in self.tokenizer.get_vocab().items() if word.endswith(model["end_of_word_suffix"])]] = True
        self.start()
        self.older: tuple = ({}, self.begin, self.size, self.flat)

    def start(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.size = np.zeros(1 << 12, "int64"), np.zeros(1 << 12, "int64")
        self.flat, self.n, self.held = np.zeros(1 << 16, "uint32"), 0, 0

    def _by_model(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same of words of small letters, whose last ids tell that they are; None if those aren't one a word."""
        texts = [b" ".join(raw[i : i + 256]).decode() for i in range(0, len(raw), 256)]
        ids = np.concatenate([np.array(x.ids, "uint32") for x in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        last = self.ends[ids].nonzero()[0]
        return (ids, np.diff(last, prepend=-1)) if len(last) == len(raw) and last[-1] == len(ids) - 1 else None

    def _tokenized(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, as texts of some hundred words; the places of the ids tell whose they are."""
        shown = [x.decode("utf-8", "replace") for x in raw]
        texts = [shown[i : i + 256] for i in range(0, len(shown), 256)]
        ids, sizes = [], []
        for part, found in zip(texts, self.tokenizer.encode_batch([" ".join(x) for x in texts], add_special_tokens=False)):
            ends = np.cumsum(np.fromiter(map(len, part), "int64", len(part)) + 1)
            first = np.fromiter((o[0] for o in found.offsets), "int64", len(found))
            ids.append(np.array(found.ids, "uint32"))
            sizes.append(np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _add(self, raw: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        have = len(self.known)
        while self.n + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), "uint32")])
        while have + len(raw) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros(len(x), "int64")]) for x in (self.begin, self.size))
        self.flat[self.n : self.n + len(ids)] = ids
        self.begin[have : have + len(raw)] = self.n + np.cumsum(size) - size
        self.size[have : have + len(raw)] = size
        self.known.update(zip(raw, range(have, have + len(raw))))
        self.n += len(ids)
        self.held += 4 * len(ids) + sum(map(len, raw)) + 120 * len(raw)

    def _learn(self, raw: list[bytes]) -> None:
        known, begin, size, flat = self.older
        if old := [x for x in raw if x in known]:
            at = np.array([known[x] for x in old])
            each = size[at]
            self._add(old, flat[np.arange(each.sum()) + np.repeat(begin[at] - np.cumsum(each) + each, each)], each)
            raw = [x for x in raw if x not in known]
        if self.model:
            small = [x.isalpha() and x.islower() or bool(self.PLAIN(x)) for x in raw]
            if any(small) and (found := self._by_model(plain := list(compress(raw, small)))):
                self._add(plain, *found)
                raw = [x for x, k in zip(raw, small) if not k]
        if raw:
            self._add(raw, *self._tokenized(raw))

    def _cut(self, words: Words) -> tuple[np.ndarray, ...]:
        """(bytes of the words without what stands between them, their bounds, the words from which a
        mark was cut, those marks)."""
        data, inside, start, end = words.data, WORD_BYTES[words.data], words.start, words.end
        cut, mark = np.zeros(0, "int64"), np.zeros(0, "uint8")
        if self.splits and words.n:
            cut = self.MARK[data[end - 1]].nonzero()[0]
            stop, size = end[cut], end[cut] - start[cut]
            before = data[np.maximum(stop - 2, 0)]
            cut = cut[self.ASCII[before] & (size > 1) | self.LATIN[before] & (data[np.maximum(stop - 3, 0)] == 0xC3) & (size > 2)]
            mark = data[end[cut] - 1]
            inside[end[cut] - 1] = False
            end = end.copy()
            end[cut] -= 1
            # a mark after the capital might make one letter of both
            big = start[self.CAPITAL[data[start]].nonzero()[0]]
            data = data.copy()
            data[big[self.LETTER[data[np.minimum(big + 1, len(data) - 1)]]]] += 32
        return data[inside], np.append(0, np.cumsum(end - start)).astype("int32"), cut, mark

    def of(self, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, each with the end id; their numbers)."""
        if self.held > self.LIMIT:
            self.older = (self.known, self.begin, self.size, self.flat)
            self.start()
        # the words as an array of strings of their own
        packed, bounds, cut, mark = self._cut(words)
        column = pa.Array.from_buffers(pa.binary(), words.n, [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
        distinct = _as_bytes(column.dictionary)
        at = list(map(self.known.get, distinct))
        if new := [x for x, k in zip(distinct, at) if k is None]:
            self._learn(new)
            at = [self.known[x] if k is None else k for x, k in zip(distinct, at)]
        # the marks that were cut off, and the end id as a word that has a space
        for x in self.MARKS:
            if bytes([x]) not in self.known:
                self._learn([bytes([x])])
        if (end := b" %d" % end_id) not in self.known:
            self._add([end], np.array([end_id], "uint32"), np.array([1]))
        n = len(words.first) - 1
        ends = words.first[1:] + np.searchsorted(cut, words.first[1:]) + np.arange(n)
        marks = cut + np.arange(1, len(cut) + 1) + np.searchsorted(words.first[1:], cut, side="right")
        items, place = np.full(words.n + len(cut) + n, self.known[end], "int32"), np.ones(words.n + len(cut) + n, bool)
        items[marks] = np.array([self.known.get(bytes([x]), 0) for x in range(256)], "int32")[mark]
        place[marks] = place[ends] = False
        items[place] = np.array(at, "int32").take(column.indices.to_numpy())
        have = len(self.known)
        listed = pa.ListArray.from_arrays(pa.array(np.append(self.begin[:have], self.n).astype("int32")), pa.array(self.flat[: self.n]))
        found = listed.take(pa.array(items))
        until = found.offsets.to_numpy()[ends + 1]
        return found.flatten().to_numpy(), np.diff(until, prepend=0).astype("int64")


def _as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls."""
    if not len(column):
        return []
    cuts = np.frombuffer(column.buffers()[1], "int32")[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    data = data.to_pybytes() if data else b""
    return [data[b:e] for b, e in pairwise(cuts)]


@lru_cache(maxsize=1)
def _words_of(path: str) -> WordIds:
    return WordIds(path)


FILE_SCHEMA = "part int, segment int, n_docs int, n_ids long, doc_ids binary, doc_null binary, doc_sizes binary, payload binary"


def segments(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """The rows of the file, in ascending doc_id order over partitions and rows."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        known = _words_of(tokenizer)
        waiting: list[tuple] = []

        def done(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            lengths = [np.append(np.full(len(ids) // block, block), len(ids) % block) for _, _, _, ids in held]
            lengths = [x[x > 0] for x in lengths]
            blocks = encode_blocks(np.concatenate([h[3] for h in held]), np.concatenate(lengths), known.bits)
            at = 0
            for (number, doc, size, ids), mine in zip(held, lengths):
                payload = b"".join(blocks[at : at + len(mine)])
                at += len(mine)
                gone = doc.is_null().to_numpy(zero_copy_only=False)
                row = {
                    "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "n_docs": pa.array([len(size)], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([np.nan_to_num(doc.to_numpy(zero_copy_only=False)).astype("<i8").tobytes()], pa.binary()), "doc_null": pa.array([gone.astype("uint8").tobytes()], pa.binary()),
                    "doc_sizes": pa.array([size.astype("<i8").tobytes()], pa.binary()), "payload": pa.array([payload], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(row)

        number, docs_in, sizes_in, ids_in, n = 0, [], [], [], 0

        def close():
            nonlocal number, docs_in, sizes_in, ids_in, n
            waiting.append((number, pa.concat_arrays(docs_in), np.concatenate(sizes_in), np.concatenate(ids_in)))
            number, docs_in, sizes_in, ids_in, n = number + 1, [], [], [], 0

        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(1), 1 << 22):
                ids, size = known.of(Words(data, offsets), end_id)
                docs_in.append(b.column(0).slice(lo, hi - lo))
                sizes_in.append(size)
                ids_in.append(ids)
                n += len(ids)
                if n >= segment:
                    close()
                if len(waiting) * segment >= 2048 * block:
                    yield from done(waiting)
                    waiting = []
        if n:
            close()
        if waiting:
            yield from done(waiting)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, FILE_SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    # the payload is coded already
    segments(docs, tokenizer, end_id).write.option("compression", "none").parquet(path)


def read_segments(df: DataFrame):
    """Yields (documents' ids, their null marks, their sizes, token ids, (part, segment, documents) of
    the segments) from batches of a file."""

    def run(batches):
        for b in batches:
            lo = 0
            sizes = b.column(3).to_numpy()
            while lo < b.num_rows:
                hi, total = lo, 0
                while hi < b.num_rows and (hi == lo or total + sizes[hi] <= 2048 * BLOCK):
                    total += int(sizes[hi])
                    hi += 1
                blocks = [x for i in range(lo, hi) for x in split_payload(b.column(7)[i].as_py())]
                ids = decode_blocks(blocks)
                size = np.concatenate([np.frombuffer(b.column(6)[i].as_buffer(), "<i8") for i in range(lo, hi)])
                doc = np.concatenate([np.frombuffer(b.column(4)[i].as_buffer(), "<i8") for i in range(lo, hi)])
                gone = np.concatenate([np.frombuffer(b.column(5)[i].as_buffer(), "uint8") for i in range(lo, hi)])
                yield doc, gone, size, ids, [tuple(b.column(j)[i].as_py() for j in (0, 1, 2)) for i in range(lo, hi)]
                lo = hi

    return run


def read_ids(df: DataFrame) -> DataFrame:
    """The documents' ids from a file: doc_id, ids."""
    read = read_segments(df)

    def run(batches):
        for doc, gone, size, ids, _ in read(batches):
            offsets = np.append(0, np.cumsum(size)).astype("int32")
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, mask=gone > 0), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype("int32")))})

    return df.mapInArrow(run, "doc_id long, ids array<int>")


def digests(df: DataFrame) -> DataFrame:
    """Of each document in a file: doc_id, start, n_tokens, ids_crc32, in the order of the file: the
    segments' numbers of ids give where each begins."""
    read = read_segments(df)

    def run(batches):
        for doc, gone, size, ids, segments_ in read(batches):
            raw = ids.astype("<u4").tobytes()
            end = np.cumsum(size)
            crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(size.tolist(), end.tolist())]
            docs_in = np.array([x[2] for x in segments_])
            first = np.cumsum(docs_in) - docs_in
            within = end - size - np.repeat((end - size)[first], docs_in)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.repeat([x[0] for x in segments_], docs_in), pa.int32()), "segment": pa.array(np.repeat([x[1] for x in segments_], docs_in), pa.int32()),
                    "doc_id": pa.array(doc, mask=gone > 0), "within": pa.array(within), "n_tokens": pa.array(size), "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    found = df.mapInArrow(run, "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long")
    begin = stored(running_totals(df.select("part", "segment", "n_ids"), [], ["part", "segment"], "n_ids").select(F.col("part").alias("_p"), F.col("segment").alias("_s"), "before"), "segment-starts")
    joined = found.join(sized(begin), (F.col("part") == F.col("_p")) & (F.col("segment") == F.col("_s")))
    return joined.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
