"""Token ids of whole texts by a tokenizer file, remembered per chunk between white space."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyframe.llm import cuts
from tallyframe.llm.memory import Memory, kept

#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1 << 21

# Texts with one of these are encoded as a whole: they break chunks in Python but not there, or begin a special token.
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
_MARKS = ".,;:!?"
#: Words encoded in one call.
_TOGETHER = 512


def _tokenizer(definition: str) -> tuple[object, Memory, np.ndarray]:
    """The tokenizer, its memory, and which ids end a word, once per worker process."""

    def make() -> tuple[object, Memory, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = json.loads(definition)["model"]
        ends, close = np.zeros(max(model["vocab"].values()) + 1, dtype=bool), model.get("end_of_word_suffix") or "</w>"
        ends[[k for token, k in model["vocab"].items() if token.endswith(close)]] = True
        return Tokenizer.from_str(definition), Memory(), ends

    return kept(("vocabulary", hash(definition)), make)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _learn(new: list[str], tokenizer: object, memory: Memory, ends: np.ndarray) -> None:
    """Remember chunks. Marks after a letter or digit are a token run of their own, so a known word is not encoded again."""
    cut = {}
    for chunk in new:
        core = chunk.rstrip(_MARKS)
        if core and core != chunk and core[-1].isalnum():
            cut[chunk] = core, chunk[len(core) :]
    need = {c for c in new if c not in cut} | {part for both in cut.values() for part in both if part not in memory and part not in memory.older}
    words = [c for c in need if c.isalpha() and _plain(c)]
    for k in range(0, len(words), _TOGETHER):
        some = words[k : k + _TOGETHER]
        ids = np.array(tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
        stops = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(stops) == len(some):  # each word gave one run of ids with one end
            raw = ids.tobytes()
            memory.update(zip(some, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
    rest = [c for c in need if c not in memory]
    for chunk, found in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
        memory[chunk] = _packed(found.ids)
    for chunk, (core, marks) in cut.items():
        memory[chunk] = memory[core] + memory[marks]


def _plain(text: str) -> bool:
    """Whether all characters are of Latin-1: these lower one by one and do not compose."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encode_texts(texts: pa.Array, definition: str) -> Iterator[bytes]:
    """For each text its ids as little-endian unsigned 32-bit numbers; a null is an empty text.

    For tokenizers that lower the text, turn white space into breaks, drop it, and
    never join what it separates, nor a word and the marks after it: then the ids of
    a text are those of its chunks, one after the other.
    """
    tokenizer, memory, ends = _tokenizer(definition)
    group: list[list[str] | str] = []
    chars = 0

    def flush() -> Iterator[bytes]:
        new = set().union(*[chunks for chunks in group if isinstance(chunks, list)])
        memory.renew()
        new = [c for c in new if c not in memory and c not in memory.older]
        _learn(new, tokenizer, memory, ends)
        for chunks in group:
            if isinstance(chunks, list):
                yield b"".join(map(memory.__getitem__, chunks))
            else:
                yield _packed(tokenizer.encode(chunks, add_special_tokens=False).ids)

    for text in texts:
        value = text.as_py() or ""
        if any(mark in value for mark in _ODD):
            group.append(value)
        else:
            # lowered first, texts have fewer different chunks
            group.append((value.lower() if _plain(value) else value).split())
        chars += len(value)
        if chars >= GROUP_CHARS:
            yield from flush()
            group, chars = [], 0
    yield from flush()


# White space goes with the word after it; a run of marks beside a letter or digit is a token run of its own.
_CUT = cuts.Cutter()
_CUT.second[: cuts.SPACE, cuts.SPACE :] = True
_CUT.second[cuts.ALNUM, cuts.MARK] = _CUT.second[cuts.MARK, cuts.ALNUM] = True


def encode_slices(texts: pa.Array, definition: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts as (ids, offsets): the same ids as ``encode_texts`` gives, gathered by numpy.

    Texts are cut into chunks as views of their bytes. Only the different chunks of a
    run are looked at, without white space and with lower ASCII letters. A text
    that may hold a special token is encoded as a whole.
    """
    tokenizer, memory, ends = _tokenizer(definition)
    for run in cuts.runs(texts, cuts.SLICE_BYTES):
        special = pc.match_substring(run, "<|")
        chunks, firsts = _CUT(pc.if_else(special, "", run))
        coded = chunks.dictionary_encode()
        bare = pc.ascii_lower(pc.ascii_trim_whitespace(coded.dictionary)).dictionary_encode()
        memory.renew()
        words = bare.dictionary.to_pylist()
        _learn([c for c in words if c not in memory and c not in memory.older], tokenizer, memory, ends)
        places = bare.indices.to_numpy()[coded.indices.to_numpy()]
        anew = {int(k): np.array(tokenizer.encode(run[int(k)].as_py(), add_special_tokens=False).ids, dtype="<u4") for k in np.flatnonzero(special.to_numpy(zero_copy_only=False))}
        yield cuts.replaced(*cuts.gather(list(map(memory.__getitem__, words)), places, firsts, "<u4"), anew)
