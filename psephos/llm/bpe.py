"""BPE encoding and decoding by a prefix-sharing trie.

Why a trie works: in byte-pair encoding the tokens of a prefix are known from its *last token* alone - the prefix before
that token is itself encoded on its own, and two neighbours stand together in an encoding exactly if the two of them,
encoded as one string, come out as those two. So a node of the trie keeps one number, the last token of its prefix; the
node's state follows from the states of its ancestors, and words that share a prefix share all states on it.

Each batch of texts puts its distinct new words into a trie, the trie is walked depth first, and every word's ids are
read off backwards through the last tokens. A word's final symbol differs from the same symbol inside a word where the
vocabulary has an end-of-word suffix, so words end in edges of their own.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.bytelevel import byte_symbols
from psephos.llm.common import Kept, arrow_map, documents, texts_as_bytes
from psephos.llm.tokens import word_bpe

#: Bounds of what a worker keeps: encoded stretches and words (twice as many, see Kept), pairs of tokens with their verdict, nodes of one trie.
REMEMBERED = 400_000
PAIRS = 1_000_000
NODES = 300_000
#: Depth to which words share nodes: what a word has beyond is one edge of the trie, walked with the same states.
SHARED_DEPTH = 256
#: Longer stretches and words are worked out each time.
LONGEST_REMEMBERED = 256
#: Symbols by which the lengths of possible last tokens are looked up, and the lengths that are always tried.
ENDING = 4
SHORT = tuple(range(ENDING - 1, 0, -1))


def sizes_by_ending(table: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """For each ending of ENDING symbols that a token has: the lengths a token with that ending may have, longest first."""
    sizes: dict[str, set[int]] = {}
    for t in table:
        if len(t) >= ENDING:
            sizes.setdefault(t[-ENDING:], set()).add(len(t))
    return {e: (*sorted(found, reverse=True), *SHORT) for e, found in sizes.items()}


class TrieBpe:
    """Encodes words by the vocabulary, merges and end-of-word suffix of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("a BPE file without decoder and post-processor is asked for")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = str.maketrans({i: s for i, s in enumerate(byte_symbols())})
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        # Tokens within a word and, without their suffix, tokens at its end: as they stand in the trie.
        self.inner = {t: i for t, i in self.vocab.items() if not (self.suffix and t.endswith(self.suffix))}
        self.final = {t.removesuffix(self.suffix): i for t, i in self.vocab.items() if t.endswith(self.suffix)} if self.suffix else self.inner
        self.inner_sizes, self.final_sizes = sizes_by_ending(self.inner), sizes_by_ending(self.final)
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.length = {i: len(t) for table in (self.inner, self.final) for t, i in table.items()}
        self.wholes: dict[int, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.digits = {i: f"{i} " for i in self.names}
        self.spaced = {i: f"{t} " for i, t in self.names.items()}
        self.words: Kept = Kept(REMEMBERED)
        self.stretches: Kept = Kept(REMEMBERED)

    def _whole(self, token: int) -> bool:
        """Whether a token's own text encodes to it alone."""
        known = self.wholes.get(token)
        if known is None:
            text = self.names[token]
            end = self.suffix if self.suffix and text.endswith(self.suffix) else ""
            known = self.wholes[token] = len(self._merged(self._units(text.removesuffix(end) if end else text, end))) == 1
        return known

    def _units(self, text: str, end: str) -> list[str]:
        return [*text[:-1], text[-1:] + end]

    def _merged(self, units: list[str]) -> list[str]:
        """Plain byte-pair merging, for tokens and pairs of tokens only."""
        while len(units) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), k) for k, pair in enumerate(zip(units, units[1:])))
            if rank == len(self.ranks):
                break
            units[at : at + 2] = [units[at] + units[at + 1]]
        return units

    def _stand(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when they are encoded as one string."""
        known = self.fits.get((left, right))
        if known is None:
            a, b = self.names[left], self.names[right]
            end = self.suffix if self.suffix and b.endswith(self.suffix) else ""
            known = self._merged(self._units(a + b.removesuffix(end) if end else a + b, end)) == [a, b]
            if len(self.fits) > PAIRS:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def _last(self, tail: str, n: int, states: list[int], table: dict[str, int]) -> int:
        """The last token of the first n symbols, which end in tail (all of them, or as many as a token can have);
        states[d] is the last token of the first d, for each d below n."""
        fits = self.fits
        for size in (self.inner_sizes if table is self.inner else self.final_sizes).get(tail[-ENDING:], SHORT):
            if size > n:
                continue
            token = table.get(tail[-size:])
            if token is None:
                continue
            if size == n:
                if self._whole(token):
                    return token
                continue
            left = states[n - size]
            known = fits.get((left, token))
            if known or (known is None and self._stand(left, token)):
                return token
        raise ValueError(f"no token ends {tail!r}")

    def _read(self, n: int, last: int, states: list[int]) -> list[int]:
        out = [last]
        n -= self.length[last]
        while n:
            out.append(states[n])
            n -= self.length[states[n]]
        return out[::-1]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of distinct words, by one depth-first walk of their trie."""
        gc.disable()  # the many nodes hold no cycles
        try:
            return self._encode_words(words)
        finally:
            gc.enable()

    def _encode_words(self, words: list[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        root: dict = {}
        nodes = 0
        for word in words:
            node = root
            shared = word[: min(len(word) - 1, SHARED_DEPTH)]
            for c in shared:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                    nodes += 1
                node = below
            node.setdefault("", []).append(word[len(shared) :])  # the edges by which words end here
            if nodes > NODES:
                self._walk(root, out)
                root, nodes = {}, 0
        self._walk(root, out)
        return out

    def _walk(self, root: dict, out: dict[str, list[int]]) -> None:
        states, path, longest = [0], "", self.longest
        stack = [(0, "", root)]
        while stack:
            depth, c, node = stack.pop()
            if depth:
                path = path[: depth - 1] + c
                del states[depth:]
                states.append(self._last(path, depth, states, self.inner))
            for below, child in node.items():
                if below:
                    stack.append((depth + 1, below, child))
                else:
                    for end in child:
                        if len(end) == 1:
                            word = path[:depth] + end
                            out[word] = self._read(depth + 1, self._last(word, depth + 1, states, self.final), states)
                            continue
                        beyond, tail, n = states[: depth + 1], path[:depth], depth
                        for symbol in end[:-1]:
                            tail, n = (tail + symbol)[-longest:], n + 1
                            beyond.append(self._last(tail, n, beyond, self.inner))
                        out[path[:depth] + end] = self._read(n + 1, self._last((tail + end[-1])[-longest:], n + 1, beyond, self.final), beyond)

    def pre_tokens(self, text: str) -> list[str | int]:
        """Words in byte symbols, and added tokens as their ids, in the order of the text."""
        out: list[str | int] = []
        for part in self.specials.split(text) if self.specials and self.specials.search(text) else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                if part.isascii() and part.isprintable():
                    out.extend(self.split.findall(part.lower()))  # these bytes are their own symbols
                    continue
                plain = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
                out.extend([w.encode("utf-8").decode("latin-1").translate(self.symbols) for w in self.split.findall(plain)])
        return out

    def _tell(self, ids: list[int]) -> tuple[str, str]:
        return "".join([self.digits[i] for i in ids]), "".join([self.spaced[i] for i in ids])

    def told(self, texts: list[bytes | None]) -> list[tuple[str, str]]:
        """For each text its ids and its tokens, each joined by spaces."""
        split = [t.split() if t else [] for t in texts]
        self.stretches.turn()
        self.words.turn()
        new = {w: self.pre_tokens(w.decode("utf-8")) for w in self.stretches.missing(set().union(*split))}
        words = self.words.missing({w for parts in new.values() for w in parts if isinstance(w, str)})
        self.words.young.update((w, self._tell(ids)) for w, ids in self.encode_words(sorted(words)).items())
        known, young, tell = self.words.young, self.stretches.young, self._tell
        for w, parts in new.items():
            each = [known[p] if isinstance(p, str) else tell([p]) for p in parts]
            young[w] = each[0] if len(each) == 1 else ("".join([t[0] for t in each]), "".join([t[1] for t in each]))
        out = []
        for s in split:
            pairs = list(map(young.__getitem__, s))
            out.append(("".join([t[0] for t in pairs])[:-1], "".join([t[1] for t in pairs])[:-1]))
        for w in [w for w in new if len(w) > LONGEST_REMEMBERED]:
            del young[w]
        for w in [w for w in words if len(w) > LONGEST_REMEMBERED]:
            del known[w]
        return out

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.told([text.encode("utf-8")])[0][0].split()))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as a file without a decoder has them; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def trie_bpe(path: str) -> TrieBpe:
    """One for each Python worker, so that what it remembers serves the worker's later tasks too."""
    return TrieBpe(path)


def bpe_round_trip(docs: DataFrame, tokenizer: str, texts: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text, or with texts=False the SHA-256 of the last two.

    ids are decimal, joined by a space. A null text counts as empty: no ids and an empty decoded text. Rows that share a
    doc_id are encoded each; further columns are not looked at. No shuffle: a worker's memory is bounded by what it
    remembers and one batch.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = trie_bpe(tokenizer).told(texts_as_bytes(batch.column(1)))
        ids, decoded = [x[0] for x in told], [x[1] for x in told]
        n = [x.count(" ") + 1 if x else 0 for x in ids]
        if not texts:
            ids, decoded = ([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in column] for column in (ids, decoded))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", *names])

    names = ["ids", "decoded"] if texts else ["ids_sha256", "decoded_sha256"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, work, f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: encode and decode every whole document."""
    return bpe_round_trip(documents(spark, sf_dir), word_bpe(), texts=False)
