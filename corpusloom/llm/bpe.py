"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf of the tree holds the rank of the merge of one symbol with its right neighbour. The root is the smallest
(rank, place), so the leftmost of the lowest-ranked merges; a merge changes three leaves, each in logarithmic time.
The vocabulary is read from a file in the format of the tokenizers library; the file's size bounds what is broadcast.

Which characters are letters, and how they are normalized, depends on a version of Unicode. Python's tables agree with
the library's on all code points but those that Python's leave unassigned, and marks that the library's normalization
doesn't know (disputed()); texts with any of these are normalized and cut into pieces by the library. Merges are made
here in either case.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC

from corpusloom.llm.common import bodies, column, slices

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed for little-endian machines with 32-bit integers")
#: A worker holds so many of the words it has met, and of those it has met before; this bounds memory and changes no result.
CACHE_WORDS = 120_000
NO_MERGE = (1 << 62) - 1
# The vocabulary's rule for pieces. No piece holds white space, so how the normalizer maps it is of no account.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


def merge_all(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """symbols after all merges. ranks: by left << 20 | right, the merge's rank << 32 and the symbol that it makes.

    The tree's leaf i is rank << 32 | i for the pair that starts at symbol i, and each inner node is the smaller of
    its two children; node 1 is the root.
    """
    n, get = len(symbols), ranks.get
    size = 1 << (n - 1).bit_length()
    tree, made = [NO_MERGE] * (2 * size), [0] * n
    a = symbols[0]
    for i in range(1, n):
        b = symbols[i]
        if found := get(a << 20 | b):
            tree[size + i - 1] = found[0] | (i - 1)
            made[i - 1] = found[1]
        a = b
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    right, left = [*range(1, n), -1], list(range(-1, n - 1))
    while (root := tree[1]) != NO_MERGE:
        i = root & 0xFFFFFFFF
        j = right[i]
        symbols[i], symbols[j] = made[i], -1
        right[i] = after = right[j]
        before = left[i]
        leaves = [(j, NO_MERGE)]
        if after >= 0:
            left[after] = i
            found = get(symbols[i] << 20 | symbols[after])
        else:
            found = None
        if found:
            made[i] = found[1]
            leaves.append((i, found[0] | i))
        else:
            leaves.append((i, NO_MERGE))
        if before >= 0:
            found = get(symbols[before] << 20 | symbols[i])
            if found:
                made[before] = found[1]
                leaves.append((before, found[0] | before))
            elif tree[size + before] != NO_MERGE:
                leaves.append((before, NO_MERGE))
        for leaf, value in leaves:
            k = size + leaf
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    return [s for s in symbols if s >= 0]


def disputed(nfc: Callable[[str], str]) -> set[str]:
    """Assigned characters whose order or composition nfc doesn't know: it changes them unlike Python's tables do."""
    # One at a time: a list of all characters takes some 100 MB of a worker.
    every = lambda: (chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    marks = {c for c in every() if unicodedata.combining(c)}
    # Between a mark of the highest class and one of a low class, a mark that is known moves.
    out = {c for c in marks if nfc(s := f"q\u0345{c}\u0334") != unicodedata.normalize("NFC", s)}
    out |= {c for c in marks if nfc(s := f"q\u0345{c}\u0316") != unicodedata.normalize("NFC", s)}
    for c in every():
        rule = unicodedata.decomposition(c)
        if rule and rule[0] != "<":
            parts = unicodedata.normalize("NFD", c)
            if nfc(parts) != unicodedata.normalize("NFC", parts) or nfc(c) != unicodedata.normalize("NFC", c):
                out |= {c, *parts, *(chr(int(x, 16)) for x in rule.split())}
    return out


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, read from the JSON text of its file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: (rank << 32, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        letters, end = byte_letters(), model["end_of_word_suffix"] or ""
        self.inner = [vocab.get(c, -1) for c in letters]
        self.last = [vocab.get(c + end, -1) for c in letters]
        names = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(names) + ")") if names else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.agreed: set[str] = set()
        self.disputed: set[str] | None = None
        bare = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][0]}
        self.library = Tokenizer.from_str(json.dumps(bare))

    def merged(self, piece: str) -> list[int]:
        raw = piece.encode()
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        symbols = [s for s in symbols if s >= 0]
        return merge_all(symbols, self.ranks) if len(symbols) > 1 else symbols

    def met(self, piece: str) -> bytes:
        found = self.older.get(piece) or pack(self.merged(piece))
        if len(piece) <= 64:
            self.cache[piece] = found
        return found

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            if self.disputed is None:
                self.disputed = disputed(NFC().normalize_str)
            new = set(text) - self.agreed
            odd = {c for c in new if unicodedata.category(c) == "Cn" or c in self.disputed}
            self.agreed |= new - odd
            if odd:
                return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
            # Lower-casing goes letter by letter, so the capital sigma has one lower form.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return _PIECES.findall(text.lower())

    def parts(self, text: str) -> Iterator[bytes]:
        get, met = self.cache.get, self.met
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield pack([self.added[part]])
            elif part:
                for piece in self.pieces(part):
                    yield get(piece) or met(piece)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.cache) >= CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        return b"".join(self.parts(text))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


_LOADED: dict[int, Vocabulary] = {}


def loaded(text: str) -> Vocabulary:
    key = hash(text)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(text)
    return _LOADED[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): one row for each row of docs; ids are packed little-endian unsigned 32-bit.

    path is read on the driver, and its content broadcast. The whole text is encoded without adding special tokens;
    the strings of special tokens in a text become these tokens. A null text counts as empty and has no tokens. Rows
    don't influence each other: rows without id and repeated rows are encoded like any other, a text of any length as a
    whole. Other columns of docs, whatever their names, are never read. An empty table gives an empty result.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = loaded(spec.value)
        for batch in slices(batches):
            ids, decoded = [], []
            for body in column(batch, "body"):
                ids.append(vocab.encode(body.as_py().decode("utf-8", "replace")))
                decoded.append(vocab.decode(ids[-1]))
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), n, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
            del ids, decoded
            pa.default_memory_pool().release_unused()

    rows = bodies(docs, id_col=id_col, text_col=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded, spelled from its packed ids; null ids give null."""
    with open(path, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def spelled(ids):
        vocab = loaded(spec.value)
        return ids.map(vocab.decode, na_action="ignore")

    return encoded.withColumn("decoded", spelled(F.col(ids_col)))
