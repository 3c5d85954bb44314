"""Token ids of whole texts by the tokenizers library, one encoding for each distinct word.

The tokenizer file must drop white space between words (its pre-tokenizer keeps no white space and no rule of it
reaches across one); then the ids of a text are those of its stretches between white space, one after the other. The
distinct stretches of many texts are told apart by Arrow; they are split into words by the file's own
pattern, and each distinct word goes once through the library's model. Stretches with characters that normalization or
added tokens could change go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.bytelevel import byte_symbols
from psephos.llm.common import arrow_map

#: Bytes of text whose distinct stretches are worked out together (or one longer text).
TOGETHER = 16 << 20
#: Words that go through the model in one call.
WORDS = 4096
#: All but printable ASCII and precomposed Latin letters, which NFC leaves and which each have one lower-case character.
UNUSUAL = regex.compile(r"[^\n\x21-\x7e¡-¬®-įı-ž]")


class Encoder:
    """many(texts) gives the ids of all texts in one array, and where each text ends in it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        self.pattern = None
        if suffix and self._usual(spec):
            # A word ends where a token with the suffix stands, so many words go through the model in one call.
            self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
            self.added = regex.compile("|".join(regex.escape(a["content"]) for a in spec["added_tokens"]) or "(?!)")
            # A space stays, as it stands between words.
            self.symbols = str.maketrans({b: c for b, c in enumerate(byte_symbols()) if b != 32})
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    @staticmethod
    def _usual(spec: dict) -> bool:
        """NFC and lower case, then a pattern whose matches are kept and put into byte symbols; anything else goes through the whole tokenizer."""
        normalizer, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [n["type"] for n in normalizer.get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        return (
            steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
            and "Regex" in parts[0]["pattern"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"] and spec.get("post_processor") is None
        )

    def _model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each word has (an empty one none)."""
        ids, sizes = [], []
        for k in range(0, len(words), WORDS):
            some = words[k : k + WORDS]
            joined = " ".join(some)
            if not joined.isascii():
                joined = joined.encode("utf-8").decode("latin-1").translate(self.symbols)
            part = np.array(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            size = np.array([1 if w else 0 for w in some], dtype=np.int32)
            last = np.flatnonzero(self.last[part]) + 1
            if len(last) != size.sum():
                raise ValueError("the model gives words without an end-of-word token")
            size[size > 0] = np.diff(last, prepend=0)
            ids.append(part)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _whole(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _model, of any stretches, by the whole tokenizer."""
        found = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *found]), np.array([len(x) for x in found], dtype=np.int32)

    def _odd(self, texts: list[str], joined: str) -> np.ndarray:
        """Which of texts, of which joined is made with line ends between, the whole tokenizer has to see."""
        odd = np.zeros(len(texts), dtype=bool)
        at = [m.start() for m in UNUSUAL.finditer(joined)] + [m.start() for m in self.added.finditer(joined)]
        if at:
            ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
            odd[np.searchsorted(ends, at, side="right")] = True
        return odd

    def _stretches(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): each distinct stretch's ids are ids[first : first + size]."""
        joined = b"\n".join(stretches).decode("utf-8", "replace")
        texts = joined.split("\n")[: len(stretches)]
        odd = np.ones(len(texts), dtype=bool) if self.pattern is None else self._odd(texts, joined)
        size = np.zeros(len(texts), dtype=np.int32)
        ids, size[odd] = self._whole([texts[k] for k in np.flatnonzero(odd).tolist()])
        first = np.zeros(len(texts), dtype=np.int64)
        first[odd] = np.cumsum(size[odd]) - size[odd]
        if not odd.all():
            if odd.any():
                joined = "\n".join([texts[k] for k in np.flatnonzero(~odd).tolist()])
            # One pass of the pattern over all of them; a line end stands after each and is a part of its own.
            parts = pa.array(self.pattern.findall(joined.lower() + "\n"), pa.string()).dictionary_encode()
            words, place = parts.dictionary.to_pylist(), parts.indices.to_numpy()
            border = words.index("\n")
            words[border] = ""
            of_words, sizes = self._model(words)
            more, stop = assembled(of_words, np.cumsum(sizes) - sizes, sizes, place)
            stop = stop[np.flatnonzero(place == border)]
            size[~odd] = np.diff(stop, prepend=0)
            first[~odd] = len(ids) + stop - size[~odd]
            ids = np.concatenate([ids, more])
        return ids, first, size

    def many(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of texts: all ids as unsigned 32-bit integers, and how many belong to the texts up to each one.

        With end_id, it follows each text's ids. A null text counts as empty.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        off = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(off[0], off[-1] - off[0]).cast(pa.binary()).dictionary_encode()
        off -= off[0]
        place, (ids, first, size) = coded.indices.to_numpy(), self._stretches(values_of(coded.dictionary))
        if end_id is not None:
            place = np.insert(place, off[1:], len(first))
            off += np.arange(len(off))
            ids, first, size = np.append(ids, np.uint32(end_id)), np.append(first, len(ids)), np.append(size, np.int32(1))
        flat, stop = assembled(ids, first, size, place)
        return flat, np.append(0, stop)[off[1:]]


def assembled(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part k is ids[first[k] : first[k] + sizes[k]]; the parts place[0], place[1] and so on in one array, and where each ends in it."""
    size = sizes[place]
    stop = np.cumsum(size, dtype=np.int64)
    n = int(stop[-1]) if len(stop) else 0
    at = np.arange(n, dtype=np.int32 if max(n, len(ids)) < 1 << 31 else np.int64)
    at += np.repeat((first[place] - (stop - size)).astype(at.dtype), size)
    return ids[at], stop


def values_of(column: pa.BinaryArray) -> list[bytes]:
    """The values of a binary column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=column.offset + len(column) + 1)[column.offset :].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose values are the bytes of data, cut at ends (counted in items)."""
    offsets = (np.append(0, ends) * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker; it remembers no texts."""
    return Encoder(path)


def id_kind(path: str, end_id: int) -> str:
    """The narrowest type that holds every id of the vocabulary."""
    return "<u2" if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def ids_with_end(docs: DataFrame, path: str, end_id: int = 1, kind: str = "<u4", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids): ids of the whole text and then end_id, as integers of the type named; a null text counts as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = encoder(path).many(batch.column(1), end_id)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends, prepend=0), pa.int64()), binaries(ids.astype(kind), ends)], ["doc_id", "n_tokens", "ids"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), work, "doc_id long, n_tokens long, ids binary", together=TOGETHER)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
