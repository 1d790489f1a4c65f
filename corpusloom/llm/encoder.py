"""A cache in front of a byte-level BPE tokenizer, shared by the operators that need token ids.

The split rule of such vocabularies cuts a text into pieces, and no merge crosses them. The rule is
applied to all bytes of a slice of texts at once: a piece starts where the class of characters
(letter, number, white space, other) changes, with exceptions for a space before a piece and for
contractions. Arrow numbers the pieces, so Python sees each distinct one of a slice once; their ids
are kept from slice to slice. Texts that hold a special token go to the tokenizer whole.
"""
from __future__ import annotations

from itertools import islice

from .common import worker_state

#: The split rule (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Pieces longer than this are not kept from slice to slice; a cache beyond ENTRIES goes back to its
#: first KEPT.
LONG, ENTRIES, KEPT = 48, 600_000, 450_000


def character_classes():
    """The class of each code point."""
    import numpy as np
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    low = "".join(map(chr, range(0xD800)))
    for text, first in ((low, 0), ("".join(map(chr, range(0xE000, 0x110000))), 0xE000)):
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                out[first + m.start() : first + m.end()] = kind
    return out


def piece_starts(raw, begins, classes):
    """Where pieces start in texts laid end to end: raw is their UTF-8 as a numpy array, begins says
    where texts that aren't empty begin. Ascending."""
    import numpy as np

    n = len(raw)
    kind = classes[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        padded = np.append(raw, np.zeros(3, np.uint8))
        b = [padded[lead + k].astype(np.int32) for k in range(4)]
        tail = [x & 0x3F for x in b]
        two, three = (b[0] & 0x1F) << 6 | tail[1], (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2]
        code = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]))
        own = classes[np.minimum(code, 0x10FFFF)]
        kind[lead] = own
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            on = b[0] >= least
            kind[np.minimum(lead[on] + k, n - 1)] = own[on]
    first = np.zeros(n + 3, bool)
    first[begins] = True
    new = first.copy()
    new[1:n] |= kind[1:] != kind[:-1]
    # The last of several white space characters stands alone before what isn't white space, and a
    # space belongs to what follows it.
    end = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
    end = end[~first[end + 1]]
    at = end.copy()
    for _ in range(3):
        at -= (raw[at] & 0xC0) == 0x80
    new[at] = True
    new[end[raw[end] == 0x20] + 1] = False
    # Contractions.
    mark = np.flatnonzero(raw == 0x27)
    mark = mark[new[mark] & ~first[mark + 1] & (mark + 1 < n)]
    if len(mark):
        padded = np.append(raw, np.zeros(3, np.uint8))
        x, y = padded[mark + 1], padded[mark + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        pair = np.zeros(len(mark), bool)
        for p in (b"re", b"ve", b"ll"):
            pair |= (x == p[0]) & (y == p[1])
        pair &= ~first[mark + 2]
        for on, size in ((one, 1), (pair, 2)):
            new[mark[on] + 1] = False
            new[mark[on] + 1 + size] = True
    return np.flatnonzero(new[:n])


class PieceCache:
    """Ids of texts. Subclasses say how distinct pieces are encoded."""

    def __init__(self, width: int, special: list[str]):
        self.dtype = "<u2" if width <= 1 << 16 else "<u4"
        self.special = special
        self.classes = character_classes()
        self.known: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, as bytes."""
        raise NotImplementedError

    def encode_alone(self, text: str) -> bytes:
        """Ids of any text, special tokens included."""
        raise NotImplementedError

    def values(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > ENTRIES:  # what came first is what comes often
            self.known = dict(islice(self.known.items(), KEPT))
        known = self.known
        out = list(map(known.get, pieces))
        new = [k for k, v in enumerate(out) if v is None]
        for k, got in zip(new, self.encode_pieces([pieces[k] for k in new]), strict=True):
            out[k] = got
            if len(pieces[k]) <= LONG:
                known[pieces[k]] = got
        return out

    def encode(self, texts):
        """(ids, ends) of an Arrow array of texts (null: empty): all ids, and how many there are up
        to each text's end."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(whole)
        alone = [self.encode_alone(t) for t in texts.take(pa.array(at)).to_pylist()]
        if len(at):
            texts = pc.if_else(pa.array(whole), "", texts)
        off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        starts = piece_starts(raw, off[:-1][off[:-1] < off[1:]], self.classes) if len(raw) else np.zeros(0, np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw))
        coded = pieces.dictionary_encode()
        every = [*self.values(coded.dictionary.to_pylist()), *alone]
        piece, size = coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, off)
        ends = size[1:].copy()
        if len(at):  # a text that was encoded whole counts as one piece
            piece = np.insert(piece, size[at], len(coded.dictionary) + np.arange(len(at)))
            ends += np.cumsum(whole)
        got = pa.array(every, pa.large_binary()).take(pa.array(piece))
        to = np.frombuffer(got.buffers()[1], np.int64, len(piece) + 1) // np.dtype(self.dtype).itemsize
        return np.frombuffer(got.buffers()[2] or b"", self.dtype, to[-1]), to[ends]


class LibraryCache(PieceCache):
    """Pieces encoded by the tokenizers library: words behind a space are joined into longer texts,
    and the ids are cut again before each token that starts with a space."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        super().__init__(self.size, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.starts = np.zeros(self.size, bool)
        for token, k in vocab.items():
            self.starts[k] = token.startswith("Ġ")

    def encode_alone(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        import numpy as np

        out: list[bytes] = [b""] * len(pieces)
        joint = [k for k, u in enumerate(pieces) if u[0] == " " and u[1:].isalpha()]
        alone = sorted(set(range(len(pieces))) - set(joint))
        chunks = [joint[k : k + 256] for k in range(0, len(joint), 256)]
        for chunk, got in zip(chunks, self.tokenizer.encode_batch_fast(["".join([pieces[k] for k in c]) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.dtype)
            cut = np.flatnonzero(self.starts[ids])
            if len(cut) != len(chunk):
                alone += chunk
                continue
            raw, w = ids.tobytes(), ids.itemsize
            ends = [*(cut[1:] * w).tolist(), len(raw)]
            for k, a, b in zip(chunk, (cut * w).tolist(), ends, strict=True):
                out[k] = raw[a:b]
        for k, got in zip(alone, self.tokenizer.encode_batch_fast([pieces[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = np.array(got.ids, self.dtype).tobytes()
        return out


def id_type(path: str) -> str:
    """The numpy type in which a vocabulary's ids are kept."""
    return worker_cache(LibraryCache, path).dtype


def worker_cache(kind: type, *args) -> PieceCache:
    """One cache per Python worker, kept from task to task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return worker_state((kind, *args), lambda: kind(*args))


def slices(texts, most: int = 4_000_000):
    """Ranges of an Arrow array of texts that hold about ``most`` bytes each, so that memory follows
    them and not the batch."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)) + 1
        yield slice(start, min(stop, len(ends)))
        start = stop
