"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch, in byte order, are walked as a trie, depth first: words that share
a prefix share its states. The state of a node is the last token of the encoding of the bytes up to
it. A vocabulary token that ends there is that last token if it may follow the state of the node
where it starts, which is so if byte-pair merging leaves the two apart. Reading the states back
from a word's last node gives its ids. Words come from the tokenizer's own split rule.

Defined cases: null and empty texts have no ids (the digest of an empty string); a special token's
string in a text is one token, as in the library; repeated rows and rows with equal or null doc_ids
each give a row; a very long text is encoded whole, in one task; of equal words one is walked, so there
are no ties; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""
from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame

from .common import tokenizer_path
from .encoder import PATTERN, PieceCache, slices, worker_cache


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for
    themselves, the rest for the letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Vocabulary, merges and the trie walk."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.id_of = {raw(t): k for t, k in spec["model"]["vocab"].items() if t not in {a["content"] for a in spec["added_tokens"]}}
        self.bytes_of = {k: t for t, k in self.id_of.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.rank.setdefault((self.id_of[a], self.id_of[b]), (r, self.id_of[a + b]))
        self.longest = max(map(len, self.id_of))
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of |= {k: t.encode() for t, k in self.special.items()}
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Plain byte-pair merging: the lowest-ranked pair first, leftmost among equals."""
        rank = self.rank
        while len(ids) > 1:
            found = min(((rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
            if found is None:
                break
            k = found[1]
            ids[k : k + 2] = [rank[ids[k], ids[k + 1]][1]]
        return ids

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens."""
        key = (left, right)
        if (got := self.fits.get(key)) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            raw = self.bytes_of[left] + self.bytes_of[right]
            got = self.fits[key] = self.merge([self.id_of[raw[k : k + 1]] for k in range(len(raw))]) == [left, right]
        return got

    def is_whole(self, token: int) -> bool:
        if (got := self.whole.get(token)) is None:
            raw = self.bytes_of[token]
            got = self.whole[token] = self.merge([self.id_of[raw[k : k + 1]] for k in range(len(raw))]) == [token]
        return got

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words. Sorted words visit the trie's nodes in depth-first order; the
        stack holds, for each prefix of the present word, its last token and where that starts."""
        out: dict[bytes, list[int]] = {}
        id_of, longest = self.id_of, self.longest
        last: list[int] = [-1]
        start: list[int] = [-1]
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    token = id_of.get(word[begin:end])
                    if token is not None and (self.is_whole(token) if begin == 0 else self.may_follow(last[begin], token)):
                        last.append(token)
                        start.append(begin)
                        break
                else:  # no node may be left without a state
                    raise ValueError(f"no token ends at byte {end} of {word[:64]!r}")
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at = start[at]
            out[word] = ids[::-1]
            before = word
        return out

    def encode_text(self, text: str) -> list[int]:
        """Ids of one text, cut at special tokens and by the split rule."""
        pieces: list = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            pieces += [self.special[part]] if k % 2 else [w.encode("utf-8") for w in self.words.findall(part)]
        ids = self.encode_words(list({p for p in pieces if not isinstance(p, int)}))
        return [k for p in pieces for k in ([p] if isinstance(p, int) else ids[p])]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class TrieCache(PieceCache):
    """Pieces encoded by the trie walk."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        super().__init__(max(self.bpe.bytes_of) + 1, list(self.bpe.special))

    def encode_alone(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.bpe.encode_text(text), self.dtype).tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        import numpy as np

        raw = [p.encode("utf-8") for p in pieces]
        ids = self.bpe.encode_words(raw)
        return [np.array(ids[r], self.dtype).tobytes() for r in raw]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    path = path or tokenizer_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache = worker_cache(TrieCache, path)
        for b in batches:
            texts, doc_ids = b.column("text"), b.column("doc_id")
            for s in slices(texts):
                ids, ends = cache.encode(texts[s])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids[s], lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    path = path or tokenizer_path()

    def run(batches):
        import pyarrow as pa

        bpe = worker_cache(TrieCache, path).bpe
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every whole text in one pass; only counts and digests leave the task."""
    path = path or tokenizer_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache = worker_cache(TrieCache, path)
        size = max(cache.bpe.bytes_of) + 1
        shown = np.array([str(k).encode() + b"," for k in range(size)], object)
        spelt = np.array([cache.bpe.bytes_of.get(k, b"") for k in range(size)], object)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            texts, doc_ids = b.column("text"), b.column("doc_id")
            for s in slices(texts):
                rows = []
                every, ends = cache.encode(texts[s])
                for ids in np.split(every, ends[:-1]):
                    text = b"".join(spelt[ids].tolist()).decode("utf-8", "replace")
                    rows.append((len(ids), sha(b"".join(shown[ids].tolist())[:-1]), sha(text.encode("utf-8"))))
                n, a, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([doc_ids[s], pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
