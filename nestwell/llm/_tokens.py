"""Exact token ids from a tokenizers file: a fast merge engine for plain texts, resynchronised chunks for huge ones."""

from __future__ import annotations

import json
import re

import numpy as np

#: Latin-1 bytes that every library classes alike and that keep their class in lower case: newline, ASCII's printable part, letters.
_PLAIN = bytes(c for c in range(256) if c == 10 or 32 <= c <= 126 or c >= 192 and c not in (215, 247))
#: The patterns of the two pre-tokenizers that the fast engine knows, as they stand in the files or the library.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The second for plain lower-case characters; and without apostrophes, its pre-tokens that aren't letters.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: The byte-level pattern for plain characters; its matches leave nothing out.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_MARKS = re.compile(r"[^a-zß-öø-ÿ\s](?:(?<![0-9])[^a-zß-öø-ÿ0-9\s]+)?")


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


def spaced_words(text: str) -> str:
    """A plain text's pre-tokens in lower case, each followed by a blank."""
    text = text.lower()
    if "'" in text:
        return " ".join([*_WORDS.findall(text), ""])
    return _MARKS.sub(r" \g<0> ", text.replace("\n", " ")) + " "


def byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on, in order."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


def ranks(spec: dict) -> dict[bytes, int] | None:
    """Merge ranks by bytes, if ids follow the order of merges; a word's end counts as a blank.

    Then an engine that joins the neighbours whose union has the least rank does what the file's merge list
    does, provided that each token encodes to itself (the tests check it for the whole vocabulary).
    """
    model, letters = spec["model"], byte_of_letter()
    suffix = model.get("end_of_word_suffix") or ""
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = len(vocab) - len(merges) - sum(x["content"] in vocab for x in spec["added_tokens"])
    if any(vocab.get(a + b if not suffix else a.removesuffix(suffix) + b) != first + k for k, (a, b) in enumerate(merges)):
        return None
    out = {}
    for token, k in vocab.items():
        if not any(token == x["content"] for x in spec["added_tokens"]):
            ends = bool(suffix) and token.endswith(suffix)
            out[bytes(letters[c] for c in (token[: -len(suffix)] if ends else token)) + b" " * ends] = k
    if suffix:
        out.setdefault(b" ", len(vocab))
    return out


_encoders: dict[str, Encoder] = {}


def encoder(text: str) -> Encoder:
    """One per Python worker and tokenizer file; ``text`` is the file's content."""
    if text not in _encoders:
        _encoders.clear()
        _encoders[text] = Encoder(text)
    return _encoders[text]


class Encoder:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Plain texts go through a faster engine over the file's own vocabulary and merge order.  Texts with
    unusual characters or a special string go to the library itself.  Texts beyond ``chunk`` characters are
    encoded in overlapping chunks, each by one or the other.
    """

    def __init__(self, text: str, chunk: int = 65_536, overlap: int = 1_024):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok, spec = Tokenizer.from_str(text), json.loads(text)
        self.chunk, self.overlap = chunk, overlap
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.guard = max([len(x) for x in self.specials], default=0) + 8
        self.normalizes = spec["normalizer"] is not None
        pre, self.fast, self.sizes, table = spec["pre_tokenizer"] or {}, None, None, ranks(spec)
        if table and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not self.normalizes:
            engine = tiktoken.Encoding("bytes", pat_str=_BYTE_LEVEL, mergeable_ranks=table, special_tokens={})
            self.fast, self.sizes = engine.encode_ordinary, np.zeros(max(table.values()) + 1, np.int64)
            self.sizes[list(table.values())] = [len(token) for token in table]
        elif table and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("pattern", {}).get("Regex") == _WORD_ENDS:
            engine = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=table, special_tokens={})
            self.fast = lambda text: engine.encode_ordinary(spaced_words(text))

    def ids(self, text: str) -> np.ndarray:
        return self.encode(text)[0]

    def encode(self, text: str) -> tuple[np.ndarray, int, int]:
        """The ids, the number of chunks, and how often an overlap was widened."""
        if not text:
            return np.empty(0, "<u4"), 1, 0
        if len(text) > self.chunk:
            return self.resync(text)
        if self._is_fast(text):
            return np.array(self.fast(text), "<u4"), 1, 0
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4"), 1, 0

    def _is_fast(self, text: str) -> bool:
        return self.fast is not None and not any(s in text for s in self.specials) and is_plain(text)

    def _chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each pre-token its first character in the whole text and its first token.

        The fast engine tells no offsets.  Where tokens are runs of the text's own bytes, their sizes add up
        to them, and the pattern itself tells where pre-tokens begin.
        """
        part = text[start:end]
        if self.sizes is not None and part and self._is_fast(part):
            ids = np.array(self.fast(part), "<u4")
            ends = np.cumsum([len(x) for x in _PIECES.findall(part)])
            at = np.concatenate([[0], ends[:-1]])
            before = at
            if not part.isascii():  # a plain character beyond ASCII is two bytes
                wide = np.frombuffer(part.encode("latin-1"), np.uint8) > 127
                before = at + np.concatenate([[0], np.cumsum(wide)])[at]
            return ids, at + start, np.searchsorted(np.cumsum(self.sizes[ids]), before, "right")
        e = self.tok.encode(part, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        first = np.flatnonzero(np.diff(words, prepend=-2))
        at = np.array([x for x, _ in e.offsets], np.int64)
        return np.asarray(e.ids, "<u4"), at[first] + start, first

    def resync(self, text: str, chunk: int | None = None, overlap: int | None = None) -> tuple[np.ndarray, int, int]:
        """Overlapping chunks, spliced where both begin a pre-token.

        The pre-tokenizer scans from left to right and its state is its position alone.  The first chunk
        is right up to its last few characters, so where the next chunk, which began anywhere, starts a
        pre-token at the same place, both go on alike: the boundary is proven.  Without a common
        boundary the first chunk is encoded again with twice the overlap, at last up to the text's end.
        """
        chunk, overlap = chunk or self.chunk, overlap or self.overlap
        n, start, out, chunks, widened = len(text), 0, [], 1, 0
        end = min(n, chunk + overlap)
        left, skip = self._chunk(text, 0, end), 0
        while end < n:
            begin = start + chunk
            stop = min(n, begin + chunk + overlap)
            right = self._chunk(text, begin, stop)
            chunks += 1
            reach = overlap
            while True:
                if end >= n:  # the widened chunk holds all that is left
                    break
                low, high = np.searchsorted(left[1], [begin, end - self.guard + 1])
                both, i, j = np.intersect1d(left[1][low:high], right[1][: np.searchsorted(right[1], end)], return_indices=True)
                ok = [k for k, p in enumerate(both) if begin <= p and p + self.guard < stop and self._clean(text, int(p))][:1]
                if ok:
                    break
                reach, widened = reach * 2, widened + 1
                end = min(n, begin + reach)
                left = self._chunk(text, start, end)
                if end - self.guard > stop:
                    stop = min(n, end + chunk)
                    right = self._chunk(text, begin, stop)
            if end >= n:
                break
            k = ok[0]
            out.append(left[0][skip : left[2][low + i[k]]])
            left, skip, start, end = right, right[2][j[k]], begin, stop
            if widened and int(both[k]) > begin + chunk:
                # the next chunk must begin behind the splice: restart the current one there
                start = int(both[k])
                end = min(n, start + chunk + overlap)
                left, skip = self._chunk(text, start, end), 0
        out.append(left[0][skip:])
        return np.concatenate(out), chunks, widened

    def _clean(self, text: str, at: int) -> bool:
        """Normalisation can't join the characters on both sides of ``at``."""
        return not self.normalizes or at == 0 or text[at].isascii() or text[at - 1] in " \n"
