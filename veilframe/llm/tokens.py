"""Cached use of public tokenizers inside Python workers."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18   # characters handled at a time
GROUP = 1 << 21     # characters of texts whose chunks are numbered together
CACHE = 330_000     # chunks kept; a full cache starts anew, which costs time, never results

# A cut before a space that precedes a visible character never divides a pre-token of
# a pattern whose words start with an optional space.
_BEFORE_WORD = re.compile(r" (?=\S)")


def segments(text: str, size: int | None = None, cut: re.Pattern = _BEFORE_WORD) -> Iterator[str]:
    """The text in parts of about ``size`` characters, each cut where ``cut`` matches (before a word's space)."""
    at, size = 0, size or SEGMENT
    while len(text) - at > size:
        m = cut.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


class ChunkCoder:
    """Encodes texts chunk by chunk: every distinct chunk is coded once while it is cached.

    ``code`` maps a list of strings to their codes (packed ids or counts). A chunk is a
    word without the space before it, which ``code`` gets back; the text's first
    chunk, which has none, is marked by ``HEAD``. The cache has two generations:
    a full young one becomes the old one, from which chunks still in use move
    back, so frequent chunks stay and memory is bounded.
    """

    HEAD = "\0"

    def __init__(self, code: Callable[[list[str]], Iterable], limit: int = CACHE):
        self.code, self.limit, self.young, self.old = code, limit, {}, {}

    def split(self, text: str) -> list[str]:
        """The chunks of a text by the simple cut."""
        if self.HEAD in text:
            return [self.HEAD + text]
        parts = text.split(" ")
        parts[0] = self.HEAD + parts[0]
        return parts

    def irregular(self, chunk: str) -> bool:
        """A chunk by which the simple split may differ from the tokenizer's."""
        return not chunk or chunk[0].isspace()

    def careful(self, text: str) -> list[str]:
        parts = _BEFORE_WORD.split(text)
        parts[0] = self.HEAD + parts[0]
        return parts

    def written(self, chunk: str) -> str:
        """The string that a chunk stands for."""
        return chunk[1:] if chunk[0] == self.HEAD else " " + chunk

    def learn(self, chunks: list[str]) -> None:
        self.young.update(zip(chunks, self.code([self.written(c) for c in chunks]), strict=True))

    def age(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}

    def coded(self, texts: list[str]) -> list[list]:
        """The codes of each text's chunks, in order."""
        self.age()
        get, out, todo, missing = self.young.get, [], [], set()
        for i, text in enumerate(texts):
            parts = self.split(text)
            codes = list(map(get, parts))
            out.append(codes)
            if None in codes:
                holes = [j for j, c in enumerate(codes) if c is None]
                todo.append((i, parts, holes))
                missing.update([parts[j] for j in holes])
        odd = {c for c in missing if c[:1] != self.HEAD and self.irregular(c)}
        if odd:
            for k, (i, parts, _) in enumerate(todo):
                if not odd.isdisjoint(parts):
                    parts = self.careful(texts[i])
                    todo[k], out[i] = (i, parts, range(len(parts))), [None] * len(parts)
                    missing.update(parts)
            missing -= odd
        self.fetch(missing)
        for i, parts, holes in todo:
            codes, table = out[i], self.young
            for j in holes:
                codes[j] = table[parts[j]]
        return out

    def fetch(self, missing: Iterable[str]) -> None:
        """Bring chunks that the young generation lacks into it."""
        young = self.young
        young.update({c: self.old[c] for c in missing if c in self.old})
        new = [c for c in missing if c not in young]
        if new:
            self.learn(new)


MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def joined_codes(coder: WordCoder, texts: list[str], kind: str) -> list[bytes]:
    """The packed codes of each text, as ``coded`` gives them, joined. Arrow splits the texts, numbers their
    distinct chunks and parts these from the marks after them, so each distinct word is looked up once; the codes
    are put together by number."""
    parts = coder.split_all(pa.array(texts, pa.string()))
    numbered = parts.flatten().dictionary_encode()
    chunks = numbered.dictionary
    stems = pc.utf8_rtrim(chunks, characters=MARKS)
    last = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
    letter = np.array([c != "" and _ends_in_letter(c) for c in _strings(last.dictionary)], bool)[last.indices.to_numpy()]
    n_marks = (pc.binary_length(chunks).to_numpy() - pc.binary_length(stems).to_numpy()) * letter
    divided = np.flatnonzero(n_marks)
    words = pc.if_else(pa.array(letter), stems, chunks).dictionary_encode()
    marks = pa.array([coder.HEAD + c[-n:] for c, n in zip(_strings(chunks.take(pa.array(divided))), n_marks[divided].tolist(), strict=True)],
                     pa.string()).dictionary_encode()
    known = _strings(words.dictionary)
    n_words = len(known)
    found, odd = coder.found(known + _strings(marks.dictionary))
    after = np.full(len(chunks), len(found))  # chunks without marks go on with an empty code
    after[divided] = n_words + marks.indices.to_numpy()
    codes = pa.array([*found, b""], pa.binary())
    whole = pc.binary_join_element_wise(codes.take(words.indices), codes.take(pa.array(after)), b"").take(numbered.indices)
    ends, bounds = np.frombuffer(whole.buffers()[1], np.int32), parts.offsets.to_numpy()
    raw = whole.buffers()[2].to_pybytes() if len(whole) and ends[len(whole)] else b""
    cut = ends[bounds].tolist()
    out = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    special = {i for i, t in enumerate(texts) if coder.HEAD and coder.HEAD in t}
    if odd:
        at = np.flatnonzero(np.isin(words.indices.to_numpy(), odd)[numbered.indices.to_numpy()])
        special.update((np.searchsorted(bounds, at, "right") - 1).tolist())
    for i in special:
        out[i] = b"".join(coder.coded([texts[i]])[0])
    return out


def _ends_in_letter(text: str) -> bool:
    """Also for a tokenizer that composes and lower-cases, by which a few letters end in a mark."""
    c = text[-1]
    return c.isalpha() and (c.isascii() or unicodedata.normalize("NFC", c).lower().isalpha())


class WordCoder(ChunkCoder):
    """For patterns in which a run of letters and a run of marks are separate
    pre-tokens: learns a word and the marks after it apart, and cuts before a line
    break that stands between visible characters."""

    def split(self, text: str) -> list[str]:
        if self.HEAD in text:
            return [self.HEAD + text]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = self.HEAD + parts[0]
        return parts

    def split_all(self, texts: pa.Array) -> pa.ListArray:
        """``split`` of texts without ``HEAD``, in Arrow."""
        return pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(self.HEAD, texts, ""), "\n", " \n"), " ")

    def irregular(self, chunk: str) -> bool:
        if chunk[:1] == "\n":
            return len(chunk) == 1 or chunk[1].isspace()
        return super().irregular(chunk)

    def written(self, chunk: str) -> str:
        return chunk if chunk[0] == "\n" else super().written(chunk)

    def written_all(self, words: list[str]) -> list[str]:
        return [" " + w if w[:1].isalnum() else self.written(w) for w in words]

    def found(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """The codes of distinct words and marks that need no division, and the places of irregular ones, whose codes are left empty."""
        self.age()
        out = list(map(self.young.get, words))
        holes = [i for i, c in enumerate(out) if c is None]
        missing = [words[i] for i in holes]
        odd = [i for i, w in zip(holes, missing, strict=True) if not w[:1].isalnum() and w[:1] != self.HEAD and self.irregular(w)]
        if odd:
            for i in odd:
                out[i] = b""
            holes = [i for i in holes if out[i] is None]
            missing = [words[i] for i in holes]
        codes = list(map(self.old.get, missing))
        new = [w for w, c in zip(missing, codes, strict=True) if c is None]
        learnt = iter(self.code(self.written_all(new)) if new else ())
        codes = [next(learnt) if c is None else c for c in codes]
        self.young.update(zip(missing, codes, strict=True))
        for i, c in zip(holes, codes, strict=True):
            out[i] = c
        return out, odd

    def learn(self, chunks: list[str]) -> None:
        divided, plain = {}, set()
        for c in chunks:
            stem = c.rstrip(MARKS)
            if len(stem) < len(c) and stem and _ends_in_letter(stem):
                divided[c] = stem, self.HEAD + c[len(stem):]
            else:
                plain.add(c)
        for pair in divided.values():
            plain.update(x for x in pair if x not in self.young)
        super().learn(list(plain))
        table = self.young
        for c, (stem, marks) in divided.items():
            table[c] = table[stem] + table[marks]


class SpacelessCoder(WordCoder):
    """For tokenizers that drop white space and letter case: chunks are lower-cased words."""

    HEAD = ""

    def split(self, text: str) -> list[str]:
        text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return text.replace("\n", " ").split(" ")

    def split_all(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")

    def irregular(self, chunk: str) -> bool:
        return False

    def written(self, chunk: str) -> str:
        return chunk

    def written_all(self, words: list[str]) -> list[str]:
        return words


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # in a text their strings are ordinary text
    return t


def id_type(size: int) -> str:
    """The smallest raw id type for a vocabulary of this size."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _word_marks(t) -> tuple[str, np.ndarray] | None:
    """How ids tell words apart: by id, whether a byte-level token starts with a space ("first"), or
    whether a token ends a word ("last"); None for other tokenizers."""
    from tokenizers.pre_tokenizers import ByteLevel

    suffix, vocabulary = getattr(t.model, "end_of_word_suffix", None), t.get_vocab()
    if suffix and not all(c + suffix in vocabulary for c in ByteLevel.alphabet()):
        return None  # a word's end may be left out
    marks = np.zeros(t.get_vocab_size(with_added_tokens=True), bool)
    for token, i in vocabulary.items():
        marks[i] = token.endswith(suffix) if suffix else token.startswith("\u0120")
    return ("last" if suffix else "first", marks) if marks.any() else None


def _batch_code(t, kind: str) -> Callable[[list[str]], list[bytes]]:
    """Codes of many strings. Words of letters are encoded joined: strings of the form " word" (one
    space, at the start), of which each begins at a token that starts with a space, or, where a
    suffix ends words, strings of the form "word", of which each ends at a token with the suffix."""
    told = _word_marks(t)

    def each(strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, kind).tobytes() for e in t.encode_batch_fast(strings, add_special_tokens=False)]

    def code(strings: list[str]) -> list[bytes]:
        if told is None:
            return each(strings)
        side, marks = told
        out: list = [None] * len(strings)
        if side == "last":
            word = [s.isalpha() and len(s) < 200 for s in strings]
        else:
            word = [s[1:].isalpha() and s[0] == " " and len(s) < 200 for s in strings]
        joined = [i for i, w in enumerate(word) if w]
        single = [i for i, w in enumerate(word) if not w]
        for i, c in zip(single, each([strings[i] for i in single]), strict=True):
            out[i] = c
        groups = [joined[i:i + 500] for i in range(0, len(joined), 500)]
        between = " " if side == "last" else ""
        for group, e in zip(groups, t.encode_batch_fast([between.join([strings[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, kind)
            cuts = np.flatnonzero(marks[ids])
            if len(cuts) != len(group) or (side == "last" and cuts[-1] + 1 != len(ids)):
                for i, c in zip(group, each([strings[i] for i in group]), strict=True):
                    out[i] = c
                continue
            width, raw = ids.itemsize, ids.tobytes()
            at = [0, *((cuts + 1) * width).tolist()] if side == "last" else [*(cuts * width).tolist(), len(raw)]
            for k, i in enumerate(group):
                out[i] = raw[at[k]:at[k + 1]]
        return out

    return code


_CODERS: dict[str, tuple[ChunkCoder, str]] = {}


def id_coder(path: str) -> tuple[ChunkCoder, str]:
    """This worker's coder from chunks to packed ids, and the id type."""
    if path not in _CODERS:
        t = load_tokenizer(path)
        kind = id_type(t.get_vocab_size(with_added_tokens=True))
        # a white-space run leaves no id where the tokenizer drops white space
        drops = not t.encode(" \n", add_special_tokens=False).ids and t.encode("A a").ids[0] == t.encode("a").ids[0]
        _CODERS[path] = (SpacelessCoder if drops else WordCoder)(_batch_code(t, kind)), kind
    return _CODERS[path]


def encode_texts(texts: Iterable[str | None], path: str, end_id: int) -> Iterator[bytes]:
    """Packed ids of each text, with the end id. Texts go through in groups of about
    ``GROUP`` characters, and a long one in segments."""
    coder, kind = id_coder(path)
    end = np.array([end_id], kind).tobytes()
    group: list[str] = []
    size = 0
    for text in texts:
        text = "" if text is None else text
        if group and size + len(text) > GROUP:
            for ids in joined_codes(coder, group, kind):
                yield ids + end
            group, size = [], 0
        if len(text) > GROUP:
            yield b"".join(b"".join(coder.coded([s])[0]) for s in segments(text)) + end
            continue
        group.append(text)
        size += len(text)
    if group:
        for ids in joined_codes(coder, group, kind):
            yield ids + end
