"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token marks a certain cut: no merge can span it, so
the text may be cut there and the fragments encoded independently, provided that the split of the
text into words, which comes before the merges, does not look across the cut either. That holds
where a blank follows a visible character, as the patterns in use let a blank start a piece but
never end one, and where a letter or digit meets ASCII punctuation, which they never join. Texts
where other symbols touch punctuation, or blanks follow blanks, are cut at fewer places. In long
fragments, as of scripts without blanks, a cut falls between any two letters beyond ASCII whose
meeting bytes are in no token. Fragments repeat, so their ids are kept, packed, in a bounded table
that is dropped when a task ends, and a text becomes a concatenation of table entries.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, tidy

#: Fragments of a generation of a worker's table (some 25 MB), and the longest that is worth keeping (in characters).
KEPT_FRAGMENTS, KEPT_LENGTH = 100_000, 64
#: Characters beyond which a fragment with letters beyond ASCII is looked at for cuts between letters.
LONG = 16


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the public tokenizers package on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """Byte of each letter that byte-level vocabularies are written in.

    Printable bytes stand for themselves; the others follow from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _wide_letters() -> np.ndarray:
    """Which code points beyond ASCII are letters; those that compose with letters are left out."""
    out = np.zeros(0x110000, dtype=bool)
    out[0x80:0xD800] = [unicodedata.category(chr(c))[0] == "L" for c in range(0x80, 0xD800)]
    out[0xE000:] = [unicodedata.category(chr(c))[0] == "L" for c in range(0xE000, 0x110000)]
    for low, high in ((0x1100, 0x1200), (0xA960, 0xA980), (0xD7B0, 0xD800)):
        out[low:high] = False
    return out


#: Characters whose fragments are looked up together.
LOOKED_UP = 1 << 20


class _Fragments(dict):
    """Packed ids by fragment; what is asked for and not there is noted."""

    def __init__(self):
        super().__init__()
        self.missed: list[str] = []

    def __missing__(self, fragment: str) -> None:
        self.missed.append(fragment)


class ForcedBoundaryBPE:
    """A tokenizers file, encoded by fragments. Its results equal the library's on every text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.pieces: dict[int, bytes] = {}
        inside = np.zeros((256, 256), dtype=bool)
        for token, k in vocab.items():
            plain = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            if token in self.special or not all(c in letters for c in plain):
                continue
            raw = bytes(letters[c] for c in plain)
            self.pieces[k] = raw
            if len(raw) > 1:
                b = np.frombuffer(raw, dtype=np.uint8)
                inside[b[:-1], b[1:]] = True
        self.pieces |= {k: t.encode() for t, k in self.special.items()}
        #: Last bytes of characters after which a blank is a certain cut.
        self.cut_after = ~inside[:, 0x20]
        never = "".join(re.escape(chr(b)) for b in range(0x80) if not self.cut_after[b] and not chr(b).isspace())
        wide = "" if self.cut_after[0x80:0xC0].all() else "\x7f-\U0010ffff"
        #: Where this matches before a blank, that blank is no cut.
        self.uncut = re.compile(rf"[\s\x1c-\x1f{never}{wide}] ")
        plain = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", dtype=np.uint8)
        signs = [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and not inside[plain, b].any() and not inside[b, plain].any()]
        sign = "".join(re.escape(chr(b)) for b in signs)
        self.sign = re.compile(f"[{sign}]") if sign else re.compile("(?!)")
        #: Runs between cuts, with the blank before them, and without blanks.
        self.spaced, self.bare = re.compile(rf" ?[^\s{sign}]+| ?[{sign}]+|\s"), re.compile(rf"[^\s{sign}]+|[{sign}]+")
        # Letters that a normaliser may turn into a letter and a mark count as other symbols, as does the low line.
        turned = [c for c in map(chr, [0x130, *range(0x900, 0x1000), *range(0xFB00, 0xFB50)]) if c.isalnum() and not all(map(str.isalnum, unicodedata.normalize("NFC", c).lower()))]
        other = rf"(?:[^\w\s{sign}]|[{''.join(turned)}{'' if ord('_') in signs else '_'}])"
        #: Texts where this matches may not be cut at signs.
        self.touching = re.compile(rf"{other}[{sign}]|[{sign}]{other}")
        self.other, self.separators = re.compile(other), re.compile("[\x1c-\x1f]")
        self.doubled = re.compile(r"\s\s")
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        #: Whether a cut may fall inside words: no end-of-word marks, no normaliser.
        self.inner = not self.suffix and not spec.get("normalizer")
        self.never = ~inside
        self.forget()

    def forget(self) -> None:
        """Empty the table of fragments: ids in two generations, a full one replaces the older."""
        self.known, self.older = _Fragments(), {}

    def between_letters(self, fragment: str) -> list[str]:
        """A fragment cut between letters beyond ASCII whose meeting bytes are inside no token."""
        code = np.frombuffer(fragment.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _wide_letters()[code]
        both = np.flatnonzero(letter[1:] & letter[:-1])
        if not len(both):
            return [fragment]
        last, after = 0x80 | (code[both] & 0x3F), code[both + 1]
        first = np.where(after < 0x800, 0xC0 | after >> 6, np.where(after < 0x10000, 0xE0 | after >> 12, 0xF0 | after >> 18))
        cuts = (both[self.never[last, first]] + 1).tolist()
        return [fragment[i:j] for i, j in zip([0, *cuts], [*cuts, len(fragment)], strict=True)]

    def fragments(self, text: str) -> list[str]:
        """Pieces of text between certain cuts; joined by one blank each they give the text."""
        parts = text.split(" ")
        if not self.uncut.search(text) and not text.startswith(" "):
            return parts
        out: list[str] = []
        held = parts[0]
        for part in parts[1:]:
            if not held or self.uncut.fullmatch(held[-1] + " "):
                held += " " + part
            else:
                out.append(held)
                held = part
        return [*out, held]

    def _learn(self) -> list[str]:
        """Add the fragments that were missed; those too long to keep are returned."""
        known, new = self.known, []
        for k in dict.fromkeys(known.missed):
            x = self.older.get(k)
            if x is None:
                new.append(k)
            else:
                known[k] = x
        known.missed.clear()
        for k, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[k] = np.array(e.ids, dtype="<u4").tobytes()
        return [k for k in new if len(k) > KEPT_LENGTH]

    def uncuttable(self, text: str) -> bool:
        """Whether signs are no cuts in this text."""
        return bool(self.separators.search(text) or (self.other.search(text) and self.touching.search(text)))

    def _pieces(self, text: str) -> list[str]:
        if not self.uncuttable(text) and not self.doubled.search(text):
            out = self.spaced.findall(text)
        else:
            first, *rest = self.fragments(text)
            out = [first, *map(" ".__add__, rest)]
        if not self.inner or text.isascii():
            return out
        return [y for x in out for y in (self.between_letters(x) if len(x) > LONG and not x.isascii() else (x,))]

    def _split(self, text: str | None) -> list[str]:
        """Fragments of a whole text, special tokens among them."""
        if not text:
            return []
        if self.marks is None or not self.marks.search(text):
            return self._pieces(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*(self._pieces(text[at : m.start()]) if m.start() > at else []), m[0]]
            at = m.end()
        return out + (self._pieces(text[at:]) if at < len(text) else [])

    def packed(self, texts: list[str | None], split=None) -> Iterator[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers (null: none).

        Texts are taken together until they are LOOKED_UP characters, so that unknown fragments go
        to the library in few calls.
        """
        split, at = split or self._split, 0
        while at < len(texts):
            size, keys = 0, []
            while at < len(texts) and (not keys or size < LOOKED_UP):
                keys.append(split(texts[at]))
                size += len(texts[at] or "")
                at += 1
            known = self.known
            found = [list(map(known.__getitem__, k)) for k in keys]
            if known.missed:
                long = self._learn()
                found = [list(map(known.__getitem__, k)) if None in f else f for k, f in zip(keys, found, strict=True)]
                for k in long:
                    del known[k]
                if len(known) > KEPT_FRAGMENTS:
                    self.older, self.known = known, _Fragments()
            yield from map(b"".join, found)

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        return (np.frombuffer(x, dtype="<u4") for x in self.packed(texts))

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_many([text]))

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD. Only byte-level files."""
        return b"".join([self.pieces.get(k, b"\xef\xbf\xbd") for k in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def per_task(path: str, run):
    """run(bpe, batches) as a function over batches whose fragments are dropped at its end."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        try:
            yield from run(bpe, batches)
        finally:
            bpe.forget()

    return tidy(task)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of the whole texts; a null or empty text has no ids.

    path: the vocabulary file, which every executor has under this path. Rows stay in place.
    """
    text_batches(docs.sparkSession)

    def run(bpe: ForcedBoundaryBPE, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [x.view("<i4") for x in bpe.encode_many(list(pdf["text"]))]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(per_task(path, run), "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of token ids; no ids or null give the empty text. An id outside the vocabulary becomes U+FFFD."""

    def run(bpe: ForcedBoundaryBPE, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [bpe.decode(np.asarray(x, dtype=np.int64)) if x is not None else "" for x in pdf["ids"]]})

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(per_task(path, run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass over the texts: (doc_id, n_tokens, ids_sha256, decoded_sha256, lossless).

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in
    UTF-8, lossless whether it equals the input. A null text counts as empty. An empty table
    gives an empty result; repeated rows give repeated results; other columns don't matter.
    """
    text_batches(docs.sparkSession)

    def run(bpe: ForcedBoundaryBPE, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {k: str(k) for k in bpe.pieces}
        for pdf in batches:
            out = []
            for text, ids in zip(pdf["text"], bpe.encode_many(list(pdf["text"])), strict=True):
                decoded = bpe.decode(ids)
                digits = ",".join(map(names.__getitem__, ids.tolist()))
                out.append((len(ids), hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == (text or "")))
            made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "lossless"])
            made.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield made

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(per_task(path, run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, lossless): ids of the whole texts, and whether decoding gave the text back."""
    text_batches(docs.sparkSession)

    def run(bpe: ForcedBoundaryBPE, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = list(bpe.encode_many(list(pdf["text"])))
            same = [bpe.decode(x) == (t or "") for x, t in zip(ids, pdf["text"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(x) for x in ids], "ids": [x.view("<i4") for x in ids], "lossless": same})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(per_task(path, run), "doc_id long, n_tokens long, ids array<int>, lossless boolean")
