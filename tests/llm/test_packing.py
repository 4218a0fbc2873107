import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import documents, empty, rows
from tokenizers import Tokenizer

from latebound.llm.bin_completion import (best_fit_decreasing, completions, lower_bound, pack_documents, pack_lengths,
                                          search, slots)
from latebound.llm.queries import tokenizer_path
from latebound.llm.token_bins import RoomTree, best_fit_rows, pack_token_rows, positions, unpack, write_packed
from latebound.llm.tokens import Encoder, byte_ids, vocabulary_size, word_bpe


def optimum(items, cap):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for j, b in enumerate(bins):
            if b + items[i] <= cap and b not in tried:
                tried.add(b)
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def one_by_one(items, cap):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(cap - x)
    return len(rooms)


def test_search_finds_the_optimum_of_small_cases():
    rnd, better = random.Random(1), 0
    for _ in range(300):
        cap = rnd.choice([10, 20, 50])
        items = [rnd.randint(1, cap) if rnd.random() < 0.5 else rnd.randint(cap // 5, cap // 2) for _ in range(rnd.randint(1, 11))]
        counts = Counter(items)
        packed = pack_lengths(dict(counts), cap)
        used = Counter()
        for filling, n in packed:
            assert sum(filling) <= cap
            used.update({x: n * k for x, k in Counter(filling).items()})
        assert used == counts
        assert sum(n for _, n in best_fit_decreasing(dict(counts), cap)) == one_by_one(items, cap)
        best = optimum(items, cap)
        assert lower_bound(counts, cap) <= best == sum(n for _, n in packed)
        better += one_by_one(items, cap) - best
    assert better > 0  # some cases need more than best fit


def test_completions_are_undominated():
    assert completions({5: 1, 3: 2, 2: 2}, 5, 4) == [(5,)]  # fills the room alone
    found = completions({4: 1, 3: 2, 2: 2}, 7, 8)
    assert (4, 3) in found and all(sum(f) <= 7 for f in found)
    assert (2, 2) not in found


def test_slots_hold_each_rank_once():
    packed = pack_lengths({7: 5, 3: 9, 2: 4, 10: 2}, 10)
    seen = defaultdict(list)
    for length, (first, base, offset) in slots(packed).items():
        for rank in range({7: 5, 3: 9, 2: 4, 10: 2}[length]):
            run = np.searchsorted(first, rank, side="right") - 1
            seen[int(base[run] + rank - first[run])].append((int(offset[run]), length))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 10
    assert len(seen) == sum(n for _, n in packed)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_pieces_and_sequences(spark, tokenizer):
    out = pack_documents(documents(spark), tokenizer_path("word_bpe_49k.json"), capacity=256).collect()
    want = Counter()
    for ident, text, *_ in rows():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at:at + 256]
            want[ident, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= one_by_one([r["length"] for r in out], 256)
    assert pack_documents(empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


ODD = ["", " ", "a  b", "a \n b", "a\n\n b  c\t d", "\x1c sep \x1d", "nb sp em", "Ünï CÖDE ÅÄÖ é", "it's we'll I'd 'S",
       "12345 67 8.9!?", "ŠkodA ǅ ß ẞ İstanbul ŉ ſ ıI", "e\u0301 combining", "it''s 'RE don't'S x'llama", "²³¼ Ⅷ ٣", "<|x", "ÿĀ·¸ƒ", "<|endoftext|> <|startoftext|>x", "名前 テスト", "   ", " lead", "trail ", "a" * 3000, "\r\n\x0b\x0c x"]


def test_chunked_ids_equal_whole_ids(tokenizer):
    encoder = Encoder(*word_bpe(tokenizer_path("word_bpe_49k.json")))
    for text in [*ODD, *[r[1] for r in rows() if r[1]]] * 2:
        assert np.frombuffer(encoder(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]


def test_ids_of_every_letter_below_u0250(tokenizer):
    """Between letters, alone, and beside a capital: some capitals have their lower case beyond U+0250."""
    encoder = Encoder(*word_bpe(tokenizer_path("word_bpe_49k.json")))
    for c in map(chr, range(0x20, 0x250)):
        for text in (f"ha{c}in", f"HA{c}IN", c, f"{c}A b{c}", f"x{c.lower()}{c}3"):
            assert np.frombuffer(encoder(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, (hex(ord(c)), text)


def test_ids_of_random_strings(tokenizer):
    rnd = random.Random(11)
    encoder = Encoder(*word_bpe(tokenizer_path("word_bpe_49k.json")))
    pools = ["abcdefgh THE ", "".join(map(chr, range(0x20, 0x250))), "ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅ abc ", "'s't've <|>.,;:!?0123 ab", "éèüßñŁđİıſÅK \n\t"]
    for _ in range(5000):
        text = "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(1, 25)))
        assert np.frombuffer(encoder(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_byte_ids_equal_whole_ids_and_decode():
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encode = byte_ids(path, public_tokenizers.PATTERN)
    assert vocabulary_size(path) == 50256 and len(encode(None)) == 0
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    for text in [*ODD, *[r[1] for r in rows() if r[1]]] * 2:
        ids = encode(text).tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, text[:40]
        assert whole.decode(ids, skip_special_tokens=False) == text


def test_room_tree():
    rnd, tree, held = random.Random(2), RoomTree(100), Counter()
    for _ in range(2000):
        room = rnd.randint(1, 100)
        if held[room] and rnd.random() < 0.5:
            held[room] -= 1
            tree.add(room, -1)
        else:
            held[room] += 1
            tree.add(room, 1)
        ask = rnd.randint(0, 100)
        assert tree.least_at_least(ask) == min((r for r in held if held[r] and r >= ask), default=-1)


def test_best_fit_rows():
    rnd = random.Random(8)
    for _ in range(50):
        items = np.array([rnd.randint(1, 64) for _ in range(rnd.randint(1, 200))])
        got = best_fit_rows(items, 64)
        assert sorted(i for r in got for i in r) == list(range(len(items)))
        assert all(items[r].sum() <= 64 for r in got) and len(got) == one_by_one(items.tolist(), 64)


def test_matrices_round_trip(spark, tmp_path):
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    packed = pack_token_rows(documents(spark), tokenizer_path("byte_bpe_50k.tiktoken"), capacity=128, shard_tokens=3000)
    write_packed(packed, str(tmp_path / "rows"))
    parts, shards = defaultdict(list), set()
    for r in spark.read.parquet(str(tmp_path / "rows")).collect():
        shards.add(r["shard"])
        ids, cu = bytes(r["ids"]), r["cu_seqlens"]
        assert len(ids) == 4 * 128 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 128
        assert np.flatnonzero(positions(cu) == 0).tolist() == r["resets"]
        assert set(np.frombuffer(ids, "<u4")[cu[-1]:].tolist()) <= {50256}
        for ident, piece, start, seg in zip(r["doc_ids"], r["pieces"], r["starts"], unpack(ids, cu)):
            assert start == piece * 128
            parts[ident].append((piece, seg.tolist()))
    assert len(shards) > 1
    want = defaultdict(list)
    for ident, text, *_ in rows():
        want[ident].append([*whole.encode(text or "", add_special_tokens=False).ids, 50256])
    for ident, texts in want.items():
        joined = [x for _, seg in sorted(parts[ident]) for x in seg]
        if len(texts) == 1:
            assert joined == texts[0]
        else:
            assert sorted(joined) == sorted(sum(texts, []))
    assert pack_token_rows(empty(spark), tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_shards_do_not_depend_on_the_split(spark):
    docs = documents(spark).dropDuplicates(["doc_id", "text"])
    got = []
    for parts in (1, 7):
        out = pack_token_rows(docs.repartition(parts, "n_chars"), tokenizer_path("byte_bpe_50k.tiktoken"), capacity=128, shard_tokens=3000)
        got.append(sorted((tuple(map(str, r)) for r in out.collect())))
    assert got[0] == got[1] and len({r[0] for r in got[0]}) > 1


def test_many_copies_spread_over_shards(spark):
    copies = spark.range(400).selectExpr("7L AS doc_id", "repeat('the same text ', 20) AS text")
    rows = pack_token_rows(copies, tokenizer_path("byte_bpe_50k.tiktoken"), capacity=128, shard_tokens=3000).collect()
    assert sum(len(r["doc_ids"]) for r in rows) == 400
    per = Counter()
    for r in rows:
        per[r["shard"]] += len(r["doc_ids"])
    assert len(per) > 8 and max(per.values()) < 80


def test_packing_says_how_near_it_is_to_the_bound(spark):
    out = pack_documents(documents(spark), tokenizer_path("word_bpe_49k.json"), capacity=256).collect()
    assert {(r["sequences"], r["lower_bound"] <= r["sequences"], r["proven"]) for r in out} == {(len({r["sequence_id"] for r in out}), True, True)}


def test_many_pieces_in_a_sequence():
    counts = {683: 50, 1: 5000}  # a filling of more pieces than Python has frames
    packed = pack_lengths(counts, 2048, node_limit=100)
    used = Counter()
    for filling, n in packed:
        assert sum(filling) <= 2048
        used.update({x: n * k for x, k in Counter(filling).items()})
    assert used == counts and sum(n for _, n in packed) == 25


def test_search_uses_fillings_less_often_than_possible():
    for least, cap, counts in [(12, 100, {39: 4, 32: 7, 6: 3, 34: 6, 35: 5, 50: 7}),
                               (10, 50, {17: 1, 16: 5, 18: 9, 7: 4, 26: 7})]:
        assert sum(n for _, n in pack_lengths(counts, cap)) == least
        assert search(counts, cap)[1]


def test_search_says_whether_the_optimum_is_proven():
    rnd = random.Random(3)
    for _ in range(100):
        cap = rnd.choice([20, 30])
        items = [n for n in rnd.sample(range(2, cap // 2 + 1), 4) for _ in range(rnd.randint(1, 3))]
        packed, proven = search(Counter(items), cap)
        assert proven and sum(n for _, n in packed) == optimum(items, cap)
