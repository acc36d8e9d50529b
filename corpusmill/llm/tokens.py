"""Token ids of whole texts, equal to the tokenizer's own, at the cost of their distinct words.

Both tokenizers used here split a text before merging, and never across a space that follows
a non-space. So a text's ids are the ids of its space-separated chunks, one after the other;
distinct chunks of a batch are looked up once, and pieces never seen before are encoded by the
tokenizers library. Caches live in the worker process; a full one keeps what was met again.
"""

from __future__ import annotations

import array
import os
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusmill.llm.words import kept

CACHE_ENTRIES = 400_000
SLICE_BYTES = 2 << 20
JOINED_WORDS = 4096

# How the public word-level tokenizer splits lower-cased text.
WORD_PATTERN = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
# How the public byte-level tokenizer splits text whose white space is single.
BYTE_PATTERN = r"('(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s)"
# Chunks of other characters, or with longer white space, are encoded whole.
SEEN = r"[\x21-\x7e\x{a1}-\x{ac}\x{ae}-\x{ff}]+"
PLAIN = rf"^{SEEN}(\n{SEEN})*$"
BLANK_END = r"(^|[\s\x0b\x1c-\x1f\x{85}\p{Z}])$"

NOTHING = pa.scalar(b"", pa.large_binary())
LINE_END = 3
KINDS = np.array([LINE_END if c == "\n" else 2 * c.isdigit() + c.isalpha()
                  for c in map(chr, range(128))], np.int8)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode`` gives the little-endian 32-bit ids of each text, with ``end_id`` after them."""

    def __init__(self, path: str, end_id: int, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = pa.scalar(int(end_id).to_bytes(4, "little"), pa.large_binary())
        self.spaced = spaced  # chunks keep the space before them, and case counts
        self.pattern = BYTE_PATTERN if spaced else WORD_PATTERN
        self.places: dict[str, int] = {}  # pieces seen, and where their ids are in ``stored``
        self.stored = pa.array([], pa.large_binary())
        self.met = np.zeros(0, bool)  # which of them were looked up again

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", x.ids).tobytes() for x in found]

    def _joined(self, words: list[str]) -> pa.Array:
        """Ids of words, encoded as one text: the tokenizer cuts it into these words, numbers
        them, and merges inside a word only. Otherwise they are encoded one by one."""
        out = [pa.array([], pa.large_binary())]
        for k in range(0, len(words), JOINED_WORDS):
            some = words[k:k + JOINED_WORDS]
            found = self.tokenizer.encode(("" if self.spaced else " ").join(some),
                                          add_special_tokens=False)
            number = np.array(found.word_ids, np.int64)
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            if len(starts) != len(some):
                out.append(pa.array(self._direct(some), pa.large_binary()))
                continue
            ids = np.array(found.ids, "<u4")
            out.append(pa.Array.from_buffers(pa.large_binary(), len(some), [
                None, pa.py_buffer(4 * np.append(starts, len(ids)).astype(np.int64)),
                pa.py_buffer(ids)]))
        return pa.concat_arrays(out)

    def _new(self, pieces: list[str], words: bool) -> tuple[list[str], pa.Array]:
        """Distinct pieces and their ids. Those of ASCII are words too, whatever they consist of,
        if a space sets them apart."""
        pieces = list(dict.fromkeys(pieces))
        if words:
            return pieces, self._joined(pieces)
        ahead = " " if self.spaced else ""
        apart = [p.isascii() and p.startswith(ahead) and not p.isspace() for p in pieces]
        joined = list(compress(pieces, apart))
        alone = [p for p, a in zip(pieces, apart) if not a]
        return joined + alone, pa.concat_arrays(
            [self._joined(joined), pa.array(self._direct(alone), pa.large_binary())])

    def _cached(self, pieces: list[str], words: bool) -> pa.Array:
        """Ids of the pieces, which are all words of letters or not; new ones are encoded."""
        at = np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        self.met[at[at >= 0]] = True
        if len(missing):
            new, ids = self._new([pieces[i] for i in missing.tolist()], words)
            if len(self.places) + len(new) > CACHE_ENTRIES:
                stay = np.flatnonzero(self.met)
                if len(stay) > CACHE_ENTRIES // 2:
                    stay = np.unique(at[at >= 0])
                names, moved = list(self.places), np.full(len(self.met) + 1, -1)
                moved[stay] = np.arange(len(stay))
                at = moved[at]
                self.stored, self.met = self.stored.take(pa.array(stay)), np.zeros(len(stay), bool)
                self.places = {names[k]: n for n, k in enumerate(stay.tolist())}
            self.places.update(zip(new, range(len(self.stored), len(self.stored) + len(new))))
            self.stored = pa.concat_arrays([self.stored, ids])
            self.met = np.concatenate((self.met, np.zeros(len(new), bool)))
            at[missing] = [self.places[pieces[i]] for i in missing.tolist()]
        return self.stored.take(pa.array(at))

    def _chunk_ids(self, chunks: pa.Array, plain: np.ndarray) -> pa.Array:
        """Ids of distinct chunks, for plain ones from those of the pieces they split into."""
        out = np.empty(len(chunks), np.int64)  # places in ``parts``, which hold one chunk each
        word = plain & pc.utf8_is_alpha(chunks).to_numpy(zero_copy_only=False)
        groups, found = [], 0
        for chosen, way in ((word, self._words), (plain & ~word, self._split), (~plain, self._whole)):
            at = np.flatnonzero(chosen)
            if len(at):
                groups.append(way(chunks.take(pa.array(at))))
                out[at] = np.arange(len(at)) + found
                found += len(at)
        return pa.concat_arrays(groups).take(pa.array(out))

    def _words(self, chunks: pa.Array) -> pa.Array:
        lowered = chunks if self.spaced else pc.utf8_lower(chunks)
        return self._cached(_strings(self._ahead(lowered)), True)

    def _whole(self, chunks: pa.Array) -> pa.Array:
        return pa.array(self._direct(self._ahead(chunks).to_pylist()), pa.large_binary())

    def _split(self, chunks: pa.Array) -> pa.Array:
        text = self._ahead(chunks if self.spaced else pc.utf8_lower(chunks))
        # Only apostrophes and other alphabets need the pattern: runs of a kind are pieces.
        simple = pc.and_not(pc.string_is_ascii(text), pc.match_substring(text, "'")).to_numpy(
            zero_copy_only=False)
        out = np.empty(len(text), np.int64)
        at, groups = np.argsort(~simple, kind="stable"), []
        out[at] = np.arange(len(text))
        most = int(simple.sum())
        for part, cut in ((at[:most], self._runs), (at[most:], self._matches)):
            if len(part):
                offsets, pieces = cut(text.take(pa.array(part)))
                coded = pieces.dictionary_encode()
                ids = self._cached(_strings(coded.dictionary), False)
                groups.append(pc.binary_join(
                    pa.LargeListArray.from_arrays(offsets, ids.take(coded.indices)), NOTHING))
        return pa.concat_arrays(groups).take(pa.array(out))

    def _runs(self, text: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Texts of ASCII cut where letters, digits and other characters meet, and around each
        line end; a text's first space goes with what follows."""
        text = text.cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        kind = KINDS[data]
        if self.spaced:
            kind[ends[:-1]] = kind[ends[:-1] + 1]
        new = np.ones(len(data) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == LINE_END)
        new[ends] = True
        cuts = np.flatnonzero(new)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [
            None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        return pa.array(np.searchsorted(cuts, ends)), pieces

    def _matches(self, text: pa.Array) -> tuple[pa.Array, pa.Array]:
        marked = pc.replace_substring_regex(text, pattern=self.pattern, replacement="\\1\0")
        if not self.spaced:
            marked = pc.replace_substring(marked, pattern="\n", replacement="")
        parts = pc.split_pattern(marked, "\0")
        return parts.offsets.cast(pa.int64()), parts.flatten()

    def _ahead(self, chunks: pa.Array) -> pa.Array:
        """Chunks with the space before them; a text's first one is looked up without."""
        return pc.binary_join_element_wise(" ", chunks, "") if self.spaced else chunks

    def encode(self, texts: pa.Array) -> pa.Array:
        """A binary array; null must have been filled."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        vocab = coded.dictionary
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        plain = pc.and_not(pc.match_substring_regex(vocab, PLAIN),
                           pc.match_substring(vocab, "<|")).to_numpy(zero_copy_only=False)
        direct = {}
        if self.spaced:
            # A first chunk, and a space after white space, are not cut off as other chunks are.
            odd = np.flatnonzero(~plain)
            blank = np.zeros(len(vocab), bool)
            blank[odd] = pc.match_substring_regex(
                vocab.take(pa.array(odd)), BLANK_END).to_numpy(zero_copy_only=False)
            first = codes[offsets[:-1]]
            heads = pc.unique(vocab.take(pa.array(first)))
            place = dict(zip(heads.to_pylist(), range(len(heads))))
            head_ids = self._direct(heads.to_pylist())
            at = [place[v] for v in vocab.take(pa.array(first)).to_pylist()]
            codes[offsets[:-1]] = np.array(at, np.int64) + len(vocab)
            whole = np.flatnonzero(np.logical_or.reduceat(
                np.concatenate((blank, np.zeros(len(heads), bool)))[codes],
                offsets[:-1]) | blank[first])
            direct = dict(zip(whole.tolist(), self._direct(
                texts.take(pa.array(whole)).to_pylist())))
        ids = self._chunk_ids(vocab, plain)
        if self.spaced:
            ids = pa.concat_arrays([ids, pa.array(head_ids, pa.large_binary())])
        joined = pc.binary_join(pa.LargeListArray.from_arrays(
            pa.array(offsets), ids.take(pa.array(codes))), NOTHING)
        if direct:
            mask = np.zeros(len(texts), bool)
            mask[list(direct)] = True
            joined = pc.replace_with_mask(joined, pa.array(mask), pa.array(
                [direct[i] for i in sorted(direct)], pa.large_binary()))
        return pc.binary_join_element_wise(joined, self.end, NOTHING)


def encoder(path: str, end_id: int, spaced: bool) -> Encoder:
    """This process's encoder; tasks that follow in the worker find its caches filled."""
    key = (path, end_id, spaced)
    return kept(("encoder", *key), lambda: Encoder(*key))
