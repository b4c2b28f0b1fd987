"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A merge can only join neighbouring bytes that stand next to each other inside
some vocabulary token.  A byte pair that occurs inside no token is therefore a
certain cut, and the pieces between cuts can be encoded independently and put
together again.  After the tokenizer's own pre-tokenisation, each pre-token is
cut at such pairs; the pieces are encoded once per distinct pre-token (a bounded
cache of each task) with the ranked merges of the vocabulary file.  The new
pre-tokens of some hundred texts are merged together: in each round every piece
makes the merge of its lowest rank, leftmost first, until none has one left.

The vocabulary file (a ``tokenizers`` JSON file) is read on the driver and
broadcast; its size is that of the vocabulary, whatever the documents are.
Special tokens in a text become their ids, as the library does by default.
Only what the operator's file needs is built: byte-level pre-tokenisation
without a normaliser or prefix space; other files are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tern.llm.common import need, parts_of, text_of

# fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 200_000  # distinct pre-tokens a task remembers
LONGEST = 64  # letters of a pre-token that is remembered; a longer one is merged by itself
SHORT = 64  # bytes of a piece whose merges are searched in a list
ID_MASK = (1 << 24) - 1
NO_STEP = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in a byte-level vocabulary:
    printable Latin-1 bytes are themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """The parts of a vocabulary file that encoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE":
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = {raw(k): v for k, v in model["vocab"].items() if k not in special}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    # a step is the rank of a merge, then the id that it makes
    steps = {(ids[raw(a)], ids[raw(b)]): i * (ID_MASK + 1) + ids[raw(a + b)] for i, (a, b) in enumerate(merges)}
    return {"ids": ids, "steps": steps, "special": special}


class Coder:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.ids, self.steps = vocabulary["ids"], vocabulary["steps"]
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.token = {i: t for t, i in self.ids.items()}
        self.special = vocabulary["special"]
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.digits = {i: f"{i}," for i in self.token}
        self.inside = {p for t in self.ids for p in zip(t, t[1:])}
        self.cut = np.ones(1 << 16, bool)
        self.cut[[a << 8 | b for a, b in self.inside]] = False
        self.first = np.array(self.single, np.int64)
        # merges by their pair, as sorted numbers; the last one is no pair's
        pairs = np.array([a << 32 | b for a, b in self.steps] + [1 << 62], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_step = pairs[order], np.array([*self.steps.values(), NO_STEP], np.int64)[order]
        two = np.arange(1 << 16)
        self.byte_step = self._steps(self.first[two >> 8], self.first[two & 255])
        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, tuple[bytes, str, bytes]] = {}

    def pieces(self, raw: bytes) -> list[bytes]:
        """``raw`` cut at the byte pairs that no token contains."""
        inside = self.inside
        cuts = [i for i, p in enumerate(zip(raw, raw[1:]), 1) if p not in inside]
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])] if cuts else [raw]

    def merged(self, piece: bytes) -> list[int]:
        """Ranked merges within one piece, lowest rank first, leftmost first."""
        ids = [self.single[b] for b in piece]
        if len(ids) > SHORT:
            return self._merged_long(ids)
        steps, none = self.steps, NO_STEP
        todo = [steps.get(p, none) for p in zip(ids, ids[1:])]
        while todo and (step := min(todo)) != none:
            i = todo.index(step)
            ids[i : i + 2] = [step & ID_MASK]
            del todo[i]
            if i:
                todo[i - 1] = steps.get((ids[i - 1], ids[i]), none)
            if i < len(todo):
                todo[i] = steps.get((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same for a long piece, with a heap and linked neighbours."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        steps = self.steps
        heap = [(steps[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in steps]
        heapq.heapify(heap)
        while heap:
            step, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two was merged since
            made = ids[i] = step & ID_MASK
            ids[j] = -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (made, ids[k]) in steps:
                    heapq.heappush(heap, (steps[made, ids[k]], i, made, ids[k]))
            if (h := left[i]) >= 0 and (ids[h], made) in steps:
                heapq.heappush(heap, (steps[ids[h], made], h, ids[h], made))
        return [x for x in ids if x >= 0]

    def _steps(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The step that joins each pair of ids."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_step[at], NO_STEP)

    def merged_together(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        new = np.zeros(len(data), bool)
        new[1:] = self.cut[data[:-1] << 8 | data[1:]]  # certain cuts
        new[starts] = True
        ids, piece, place = self.first[data], np.cumsum(new), np.arange(len(data))
        # the step that joins each one to the next, which is searched again only next to a merge
        step = np.full(len(ids), NO_STEP)
        step[:-1] = np.where(new[1:], NO_STEP, self.byte_step[data[:-1] << 8 | data[1:]])
        done = []
        while len(ids):
            head = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            best = np.repeat(np.minimum.reduceat(step, head), np.diff(np.append(head, len(ids))))
            over = best == NO_STEP
            done.append((place[over], ids[over]))
            pick = np.flatnonzero((step == best) & ~over)
            if not len(pick):
                break
            pick = pick[np.concatenate([[True], piece[pick[1:]] != piece[pick[:-1]]])]  # the leftmost of a piece
            ids[pick] = step[pick] & ID_MASK
            stay = ~over
            stay[pick + 1] = False
            at = (np.cumsum(stay) - 1)[pick]
            ids, piece, place, step = ids[stay], piece[stay], place[stay], step[stay]
            near = np.concatenate([at, at[at > 0] - 1])
            near = near[near < len(ids) - 1]
            step[at] = NO_STEP
            inner = piece[near] == piece[near + 1]
            step[near] = np.where(inner, self._steps(ids[near], ids[near + 1]), NO_STEP)
        place, ids = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(place)
        edge = np.searchsorted(place[order], np.append(starts, len(data))).tolist()
        ids = ids[order].tolist()
        return [ids[a:b] for a, b in zip(edge, edge[1:])]

    def _entry(self, ids: list[int]) -> tuple[bytes, str, bytes]:
        """Ids (32 bits each), their digits with a comma behind each, and their
        bytes: no containers, which the collector would have to visit."""
        digits, token = self.digits, self.token
        return array("i", ids).tobytes(), "".join([digits[i] for i in ids]), b"".join([token[i] for i in ids])

    def entries(self, texts: list[str]) -> list[list[tuple[bytes, str, bytes]]]:
        """The entries of each text's pre-tokens (and special tokens), in order."""
        split = []
        for text in texts:
            if self.marks and self.marks.search(text):
                parts, at = [], 0
                for m in self.marks.finditer(text):
                    parts += [*self.words.findall(text[at : m.start()]), m]
                    at = m.end()
                split.append(parts + self.words.findall(text[at:]))
            else:
                split.append(self.words.findall(text))
        known = self.known
        if len(known) >= CACHE:
            known.clear()
        new = [w for w in set().union(*split) if w not in known]
        rare = [w for w in new if not isinstance(w, str) or len(w) > LONGEST]
        if rare:
            known |= [(w, self._single(w)) for w in rare]
            new = [w for w in new if w not in known]
        if new:
            known |= zip(new, map(self._entry, self.merged_together([w.encode() for w in new])))
        out = [list(map(known.__getitem__, words)) for words in split]
        for w in rare:
            del known[w]
        return out

    def _single(self, w) -> tuple[list[int], str, bytes]:
        """The entry of a long pre-token or of a special token's match."""
        if not isinstance(w, str):
            return self._entry([self.special[w[0]]])
        return self._entry([i for piece in self.pieces(w.encode()) for i in self.merged(piece)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([e[0] for e in self.entries([text])[0]]), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        token = self.token
        return b"".join([token[i] for i in ids]).decode("utf-8", errors="replace")


_coder_of: tuple[dict, Coder] | None = None


def _coder(vocabulary: dict) -> Coder:
    """The coder of this worker process, made anew for another vocabulary."""
    global _coder_of
    if _coder_of is None or _coder_of[0] is not vocabulary:
        _coder_of = vocabulary, Coder(vocabulary)
    return _coder_of[1]


def with_tokens(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) added.

    Null and empty texts have no tokens.  All columns are carried along; one
    that is named ``token_ids`` is replaced.
    """
    need(docs, text_col)
    vocabulary = spark.sparkContext.broadcast(load(path))

    @F.pandas_udf("array<int>")
    def ids_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(vocabulary.value)
        for part in parts_of(texts):
            yield pd.Series([np.frombuffer(b"".join([e[0] for e in t]), np.int32) for t in coder.entries(list(part))], dtype=object)

    return docs.withColumn("token_ids", ids_of(text_of(text_col)))


def decoded(spark: SparkSession, encoded: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded`` (the text of its ids) added; null ids give
    the empty text."""
    vocabulary = spark.sparkContext.broadcast(load(path))

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(vocabulary.value)
        for part in parts_of(ids):
            yield pd.Series([coder.decode(x.tolist() if x is not None else []) for x in part], dtype=object)

    return encoded.withColumn("decoded", text(F.col(ids_col)))


def digests(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256``: encodes, decodes the ids, and hashes both, so that
    ids need not leave the task.  Input columns of these names are replaced."""
    need(docs, text_col)
    vocabulary = spark.sparkContext.broadcast(load(path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def summary(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(vocabulary.value)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for part in parts_of(texts):
            rows = []
            for found in coder.entries(list(part)):
                digits = "".join([e[1] for e in found])[:-1]
                decoded = b"".join([e[2] for e in found]).decode("utf-8", errors="replace")
                rows.append((digits.count(",") + bool(digits), sha(digits.encode()), sha(decoded.encode())))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = {text_col, "n_tokens", "ids_sha256", "decoded_sha256"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    return docs.select(*rest, summary(text_of(text_col)).alias("_t_s")).select(*rest, "_t_s.*")
