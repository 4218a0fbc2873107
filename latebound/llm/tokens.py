"""Token ids of whole texts, cut into pieces, for the packing operators.

A text is encoded chunk by chunk at places where the tokenizer splits anyway,
and a bounded memory of chunks already seen spares most calls: natural text
repeats its words. The ids equal those of encoding the text at once. They are
kept as bytes, little-endian unsigned 32-bit integers, so that a text's ids
are one join of byte strings.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

#: Chunks remembered by a task; beyond it the memory starts anew.
MEMORY = 600_000

#: How the word-level vocabulary cuts lower-cased text (fixed value of that public tokenizer), with its classes
#: of letters and numbers written out for characters below U+0250.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ɏ0-9²³¹¼½¾]+"


def word_bpe(path: str) -> tuple[Callable[[str], list[str]], Callable[[list[str]], list[bytes]]]:
    """A splitter and an encoder for a ``tokenizers`` file that drops white
    space between words: chunks are the runs between ASCII white space.

    Chunks of Latin letters, digits and signs need none of the normaliser's
    rules but lower case; they are cut into the vocabulary's words here, and
    the model merges each different word once. Other chunks, and those that
    may hold a special token, go through the whole tokenizer."""
    import re
    from array import array

    from tokenizers import Tokenizer

    from .token_counts import byte_symbols

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    merge, cut, known = t.model.tokenize, re.compile(WORD_PATTERN).findall, {}
    symbols = dict(enumerate(byte_symbols()))
    # Visible characters below U+0250 are composed already; the pattern's classes hold for them. A capital may have
    # its lower case beyond (as in Hausa and Ewe), so the lower-cased chunk is looked at too.
    latin = re.compile("[!-~\xa1-\xac\xae-\u024f]*").fullmatch

    def as_bytes(ids: list[int]) -> bytes:
        raw = array("I", ids)
        if sys.byteorder == "big":
            raw.byteswap()
        return raw.tobytes()

    def word_ids(word: str) -> bytes:
        ids = known.get(word)
        if ids is None:
            marks = word if word.isascii() else word.encode().decode("latin-1").translate(symbols)
            ids = as_bytes([x.id for x in merge(marks)])
            if len(word) <= 64:
                known[word] = ids
        return ids

    def encode(chunks: list[str]) -> list[bytes]:
        if len(known) > MEMORY:
            known.clear()
        out: list[bytes | None] = [
            b"".join([word_ids(w) for w in cut(low)])
            if (c.isascii() and c.isprintable() or latin(c) and latin(low)) and "<|" not in c else None
            for c, low in zip(chunks, map(str.lower, chunks))]
        rest = [c for c, ids in zip(chunks, out) if ids is None]
        whole = iter(t.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        return [np.array(next(whole).ids, dtype="<u4").tobytes() if ids is None else ids for ids in out]

    return _ascii_words, encode


def _ascii_words(text: str) -> list[str]:
    if text.isascii():
        # str.split() also splits at the separators 0x1C to 0x1F, which are no white space here.
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def vocabulary_size(path: str) -> int:
    """One more than the greatest id of a ``tiktoken`` rank file."""
    with open(path, "rb") as f:
        return 1 + max(int(line.split()[1]) for line in f)


def byte_ids(path: str, pattern: str) -> Callable[[str | None], np.ndarray]:
    """Whole texts to ids by a ``tiktoken`` rank file, as an array; no id for a null text."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str | None) -> np.ndarray:
        return enc.encode_to_numpy(text, allowed_special=set(), disallowed_special=()) if text else np.empty(0, dtype=np.uint32)

    return encode


class Encoder:
    """Ids of whole texts by a splitter and an encoder of chunks."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]]):
        self.split, self.encode, self.seen = split, encode, {}

    def __call__(self, text: str | None) -> bytes:
        chunks = [] if text is None else self.split(text)
        if len(self.seen) > MEMORY:
            self.seen = {}
        seen, long = self.seen, {}
        found = list(map(seen.get, chunks))
        if None not in found:
            return b"".join(found)
        new = list({c for c, ids in zip(chunks, found) if ids is None})
        for c, ids in zip(new, self.encode(new)):
            # Long chunks are not worth remembering beyond this text.
            (seen if len(c) <= 64 else long)[c] = ids
        if long:
            return b"".join([seen[c] if c in seen else long[c] for c in chunks])
        return b"".join([seen[c] for c in chunks])


def pieces_of(make: Callable[[], Encoder], end_id: int, capacity: int):
    """A ``mapInPandas`` function over ``id, text``: one row per piece of at
    most ``capacity`` ids, the document's ids followed by ``end_id``; only
    longer documents are cut. The checksum is that of little-endian unsigned
    32-bit integers."""
    import zlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = make(), end_id.to_bytes(4, "little")
        cols = ["id", "piece", "start", "length", "ids_crc32"]
        for pdf in batches:
            rows = []
            for ident, text in zip(pdf["id"], pdf["text"]):
                ids = encoder(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    raw = ids[at:at + 4 * capacity]
                    rows.append((ident, k, at // 4, len(raw) // 4, zlib.crc32(raw)))
            yield pd.DataFrame(rows, columns=cols)

    return run


def piece_schema(id_type: str) -> str:
    return f"id {id_type}, piece int, start long, length long, ids_crc32 long"
