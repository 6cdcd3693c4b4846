"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

The words of a batch that are not known yet form a trie, held as the words in order: read one after the other they are its depth-first walk,
and what a word shares with the one before it is the path that both have in common. On the walk every prefix gets its last token, once: the one
vocabulary entry that ends the prefix and that the merge rules leave standing next to the last token of what precedes it. A
sequence in which all neighbours stand next to each other is the encoding, so the encoding of a prefix is that of the
shorter prefix plus one token, and words with a common beginning share the work. A prefix keeps its last token and where that begins; a
word's ids are read back along these. Whether two tokens stand next to each other is found once, by running the merge rules on the two alone.

Texts are cut at white space, and the words of a piece between two blanks are looked up together when the piece comes again.

Defined results: a null or empty text has no tokens and decodes to the empty text.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trimlake.llm.common import TwoGenerations, give_back, tune

MODEL = "word_bpe_49k.json"
#: Distinct words, and pieces between blanks, in a generation of a worker's store; pairs of tokens whose meeting is remembered.
STORE = 250_000
PAIRS = 3_000_000
#: The same for the encoder that goes when its task ends.
BRIEF_STORE = 60_000

# Characters whose case, composition and class are the same in every version of Unicode, without controls that Python alone takes for white space: others take the library's own steps.
_PLAIN = re.compile("[\x00-\x1b\x20-įı-ɏ‐-‧‰-⁞]*+")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
END = "</w>"


def byte_alphabet() -> list[str]:
    """One printable character for each byte: itself if it is printable Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class WordTrieBpe:
    """Encoder for a tokenizers file whose model is BPE with a mark at the end of a word."""

    def __init__(self, path: str, store: int = STORE):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.final = {i for t, i in self.vocab.items() if t.endswith(END) and len(t) > len(END)}
        self.ending = {self.tokens[i][: -len(END)]: i for i in self.final}
        self.inner = {t: i for t, i in self.vocab.items() if i not in self.final and t not in self.special}
        self.longest = max(map(len, (*self.ending, *self.inner)))
        self.library = Tokenizer.from_file(path)
        self.bytes = byte_alphabet()
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self._beside: dict[int, bool] = {}
        self.words = TwoGenerations(store)
        self.pieces = TwoGenerations(store)

    def symbols(self, i: int) -> list[str]:
        token = self.tokens[i]
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if i in self.final else [*token]

    def merged(self, parts: list[str]) -> list[str]:
        """The merge rules, lowest rank first, leftmost first."""
        rank = self.rank
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _meet(self, a: int, b: int) -> bool:
        """Whether the merge rules leave tokens a and b (a below 0: nothing before b) as they are when they meet."""
        before = [] if a < 0 else self.symbols(a)
        return self.merged([*before, *self.symbols(b)]) == [self.tokens[x] for x in (a, b) if x >= 0]

    def _last(self, word: str, n: int, lasts: list[int], entries: dict[str, int]) -> tuple[int, int]:
        """The last token of a word's first n characters and where it begins: the longest that stands next to what precedes it."""
        beside = self._beside
        for k in range(n - self.longest if n > self.longest else 0, n):
            i = entries.get(word[k:n])
            if i is not None:
                pair = (lasts[k] << 20) + i
                ok = beside.get(pair)
                if ok is None:
                    ok = beside[pair] = self._meet(lasts[k], i)
                if ok:
                    return i, k
        raise ValueError(f"no token ends {word[:n]!r}")

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes, str]]:
        """Each word (in the byte alphabet) with its ids and decoded text, by a depth-first walk of the words' trie."""
        lasts, begins = [-1], [0]  # of the prefix of each length on the current path
        last, name, inner, ending = self._last, self.tokens, self.inner, self.ending
        if len(self._beside) > PAIRS:
            self._beside.clear()
        path = ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                shared += 1
            del lasts[shared + 1 :], begins[shared + 1 :]
            for n in range(len(lasts), len(word)):
                i, k = last(word, n, lasts, inner)
                lasts.append(i)
                begins.append(k)
            i, k = last(word, len(word), lasts, ending)
            ids = [i]
            while k:
                ids.append(lasts[k])
                k = begins[k]
            ids.reverse()
            path = word
            yield word, struct.pack(f"<{len(ids)}I", *ids), " ".join([name[i] for i in ids])

    def _keys(self, part: str) -> list[str]:
        """What a text without special strings is looked up by: its pieces, or its words in the byte alphabet after a line break."""
        if part.isascii() and _PLAIN.fullmatch(part):
            return part.lower().split()
        if _PLAIN.fullmatch(part):
            return unicodedata.normalize("NFC", part).lower().split()
        norm = self.library.normalizer.normalize_str(part)
        return ["\n" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def _learn(self, keys: set[str]) -> None:
        new = self.pieces.unknown(keys)
        signs = self.bytes
        words = {key: [key[1:]] if key[0] == "\n" else ["".join([signs[x] for x in w.encode()]) for w in _WORD.findall(key)] for key in new if key[0] != " "}
        known = self.words
        for word, ids, text in self.encode_words(known.unknown(set().union(*words.values()))):
            known.now[word] = ids, text
        for key, ws in words.items():
            found = [known.now[w] for w in ws]
            self.pieces.now[key] = found[0] if len(found) == 1 else (b"".join([e[0] for e in found]), " ".join([e[1] for e in found]))
        for key in new.difference(words):  # special strings, after a blank
            self.pieces.now[key] = self.special[key[1:]].to_bytes(4, "little"), key[1:]

    def encode_batch(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """For each text: number of tokens, ids as little-endian 32-bit integers, decoded text."""
        cut: list[list[str]] = []
        for text in texts:
            keys: list[str] = []
            done = 0
            for m in self.split_special.finditer(text) if "<|" in text else ():
                keys += [*self._keys(text[done : m.start()]), " " + m[0]]
                done = m.end()
            cut.append(keys + self._keys(text[done:]) if done else self._keys(text))
        self._learn(set().union(*cut))
        store = self.pieces.now
        out = []
        for keys in cut:
            entries = [store[k] for k in keys]
            ids = b"".join([e[0] for e in entries])
            out.append((len(ids) // 4, ids, " ".join([e[1] for e in entries])))
        return out


def new_bpe(model: str, store: int = STORE) -> WordTrieBpe:
    import public_tokenizers

    return WordTrieBpe(model if "/" in model else public_tokenizers.path(model), store)


@lru_cache(maxsize=2)
def load_bpe(model: str) -> WordTrieBpe:
    return new_bpe(model)


def _batches(b: pa.RecordBatch, encoder: WordTrieBpe) -> list[tuple[int, bytes, str]]:
    return encoder.encode_batch(["" if t is None else t for t in b.column("text").to_pylist()])


def bpe_encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids (array of int), decoded: the encoding of every text, and what it decodes to.

    A stage among others: the encoder goes when a task ends, so that workers don't hold it in other stages.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = new_bpe(model, BRIEF_STORE)
        for b in batches:
            rows = _batches(b, encoder)
            offsets = np.concatenate([[0], np.cumsum([r[0] for r in rows], dtype=np.int64)]).astype(np.int32)
            flat = np.frombuffer(b"".join(r[1] for r in rows), dtype="<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array([r[2] for r in rows], pa.string())], ["doc_id", "ids", "decoded"])
        del encoder
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same pass, with digests in place of the outputs."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _batches(b, load_bpe(model))
            sha = [[hashlib.sha256(x).hexdigest() for x in col] for col in ([r[1] for r in rows], [r[2].encode() for r in rows])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), *(pa.array(s, pa.string()) for s in sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_trie_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
