"""Token ids of whole texts with a public tokenizer, and their checksums.

A byte-level BPE never merges across the pieces its own pattern splits a text
into, and some of these borders are plain to see: a word keeps the one space
before it, and any further white space stands alone. So a text may be cut into
words and white space and each chunk encoded alone, with the ids of the whole
text as the result.

Where a text's spaces stand alone between words, Arrow cuts it at them and codes
the chunks of many texts as numbers; each distinct chunk is looked up once, and
the ids of the texts are gathered by number. Other texts are cut by a pattern.
Chunks recur, so every worker remembers the first it meets, up to a bound; later
ones are encoded whenever they come.

Where no entry of the vocabulary mixes letters, digits and marks, merges cannot
cross from one to the other, and the library's merge model needs no splitting at
all: unknown chunks of Latin letters, digits and ASCII marks are handed to it
many at a time, with line ends between them, whose id tells them apart. Any
other unknown chunk goes through the whole tokenizer. A text that holds the
string of an added token is encoded whole, and so is every text with a tokenizer
of another make.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the tokenizer's pattern knows it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]+")
#: Texts that need it: a space beside other white space, or a line end beside some (RE2, which has its own escapes).
_OTHER_SPACE = r"\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_RUNS = rf"[ \n{_OTHER_SPACE}] | [\n{_OTHER_SPACE}]|\n[{_OTHER_SPACE}]|[{_OTHER_SPACE}]\n"
WORD = re.compile(rf" ?[^{SPACE}]+")
#: Chunks of Latin letters, digits and ASCII marks; an apostrophe may start a piece of its own kind.
_PLAIN = r" ?[A-Za-z0-9!-&(-/:-@\[-`{-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
PLAIN, PLAIN_LINES = re.compile(_PLAIN), re.compile(rf"(?:{_PLAIN}\n)*{_PLAIN}")
#: Chunks a worker remembers, the longest chunk worth remembering, and unknown chunks encoded at a time.
MOST_CHUNKS, LONGEST_CHUNK, AT_A_TIME = 250_000, 64, 100


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in shown)
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


def _byte_kind(byte: int) -> str:
    """What a byte of a PLAIN chunk can belong to; empty for bytes that no such chunk has."""
    if byte in (10, 32):
        return "line" if byte == 10 else "space"
    if byte < 128:
        letter = chr(byte)
        return "letter" if letter.isalpha() else "digit" if letter.isdigit() else "mark" if letter.isprintable() and letter != "'" else ""
    return "letter" if byte < 0xC0 or 0xC3 <= byte <= 0xC9 else ""


def _mixes(vocabulary: dict[str, int], letters: dict[int, int]) -> bool:
    """Whether some entry joins bytes of unlike kinds, so that a merge could cross them; a leading space is part of its word."""
    kinds = {chr(v): _byte_kind(b) for b, v in letters.items()}
    for entry in vocabulary:
        own = [kinds.get(c, "") for c in entry]
        found = set(own[1:] if own[0] == "space" else own)
        if "" not in found and (len(found) > 1 or "space" in found):
            return True
    return False


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Encodes texts with the tokenizers library, chunk by chunk; ids are those of ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        added = made.get("added_tokens") or []
        before = made.get("pre_tokenizer") or {}
        self.added = [a["content"] for a in added]
        #: whether the tokenizer splits texts as described above
        self.splits = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer") and made["model"]["type"] == "BPE"
        self.splits = self.splits and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        letters = _byte_letters()
        self.letters = np.array([letters[b] for b in range(256)], dtype="<u2")
        self.merge = None
        self.line_end = self._encoded("\n")
        words = {w: i for w, i in made["model"].get("vocab", {}).items() if w not in self.added} if self.splits else {}
        if self.splits and len(self.line_end) == 1 and not _mixes(words, letters):
            self.tokenizer.model._resize_cache(0)  # its cache holds single words, and most that come here are new
            self.merge = self.tokenizer.model.tokenize

    def _encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, text: str) -> list[int]:
        byte_text = self.letters[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().decode("utf-16-le")
        return [t.id for t in self.merge(byte_text)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of unknown chunks."""
        out: dict[str, bytes] = {}
        plain, single = [], []
        flat = [c for c in chunks if c[0] != "\n"]
        for at in range(0, len(flat), AT_A_TIME):
            group = flat[at : at + AT_A_TIME]
            text = "\n".join(group)
            if self.merge and PLAIN_LINES.fullmatch(text) and text.count("\n") == len(group) - 1:
                self._split(group, self._merged(text), out)
            else:
                for c in group:
                    (plain if self.merge and PLAIN.fullmatch(c) else single).append(c)
        for at in range(0, len(plain), AT_A_TIME):
            group = plain[at : at + AT_A_TIME]
            self._split(group, self._merged("\n".join(group)), out)
        words = [c for c in single if len(self.line_end) == 1 and WORD.fullmatch(c)]
        for at in range(0, len(words), AT_A_TIME):
            group = words[at : at + AT_A_TIME]
            self._split(group, self._encoded("\n".join(group)), out)
        parts = {c: CHUNK.findall(c) for c in chunks if c not in out}
        inner = list(dict.fromkeys(p for own in parts.values() if len(own) > 1 for p in own))
        ids = dict(zip(inner, self.look_up(inner), strict=True)) if inner else {}
        for c, own in parts.items():
            out[c] = b"".join(ids[p] for p in own) if len(own) > 1 else np.array(self._encoded(c), dtype="<u4").tobytes()
        return out

    def _split(self, chunks: list[str], ids: list[int], out: dict[str, bytes]) -> None:
        """Adds the ids of chunks that were encoded together, line ends between them."""
        found = np.array(ids, dtype="<u4")
        ends = (np.flatnonzero(found == self.line_end[0]) * 4).tolist()
        data = found.tobytes()
        out.update(zip(chunks, [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True)], strict=True))

    def look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; new ones are encoded, and remembered while there is room."""
        known = self.known
        found = list(map(known.get, chunks))
        if None in found:
            new = self._learn(list(dict.fromkeys(c for c, ids in zip(chunks, found, strict=True) if ids is None)))
            found = [new[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
            if len(known) < MOST_CHUNKS:
                known.update((c, ids) for c, ids in new.items() if len(c) <= LONGEST_CHUNK)
        return found

    def _encode_spaced(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of texts whose spaces are alone: cut at spaces and before line ends."""
        lists = pc.split_pattern(pc.replace_substring_regex(texts, r"\n+", r" \0"), " ")
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        # the first chunk of a text has no space before it
        first, nth = np.unique(code[bounds[:-1]], return_inverse=True)
        code[bounds[:-1]] = len(words) + nth
        datas = self.look_up([w if w[:1] == "\n" else " " + w for w in words])
        datas += [self.look_up([words[i]])[0] if words[i] else b"" for i in first]
        datas.append(np.array([end], dtype="<u4").tobytes())
        code = np.insert(code, bounds[1:], len(datas) - 1)
        sizes = np.fromiter(map(len, datas), np.int64, len(datas)) // 4
        begins = np.cumsum(sizes) - sizes
        widths = sizes[code]
        upto = np.cumsum(widths)
        ids = np.frombuffer(b"".join(datas), dtype="<u4")[np.repeat(begins[code] - upto + widths, widths) + np.arange(upto[-1])]
        stops = upto[bounds[1:] + np.arange(len(texts))]
        return [ids[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text with ``end`` appended; null texts are empty."""
        texts = texts.fill_null("")
        stop, out = np.array([end], dtype="<u4").tobytes(), {}
        whole = np.full(len(texts), not self.splits)
        for added in self.added:
            whole |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        runs = ~whole & pc.match_substring_regex(texts, SPACE_RUNS).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole):
            out[i] = np.array([*self._encoded(texts[i].as_py()), end], dtype="<u4")
        for i in np.flatnonzero(runs):
            out[i] = np.frombuffer(b"".join(self.look_up(CHUNK.findall(texts[i].as_py()))) + stop, dtype="<u4")
        rest = np.flatnonzero(~whole & ~runs)
        if len(rest):
            out.update(zip(rest, self._encode_spaced(texts.take(pa.array(rest)), end), strict=True))
        return [out[i] for i in range(len(texts))]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def text_groups(texts: pa.Array, most: int = 3_000_000) -> list[tuple[int, int]]:
    """Runs of rows whose texts (or bytes) have about ``most`` bytes together."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(texts).fill_null(0)))
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            out.append((at, i))
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        out.append((at, len(sizes)))
    return out
