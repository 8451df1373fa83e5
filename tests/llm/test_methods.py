"""The helpers of the corpus operators against plain versions."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pactlens.llm import decontaminate, exact_dedup, language_id, parity_join, personal_data, rans
from pactlens.llm.byte_level import ByteLevelEncoder
from pactlens.llm.token_counts import PieceCounter

ODD = ["", " ", "  ", "a  b", "\n", "a\n b", "a \nb", "  a\n\n b", "a<|endoftext|>b", "it's we'll 's '", "x\n's", "日本 語 a_b 1 2", "a ", "a\t b", "é b  c",
       "word.\nNext one.\n", "A.\n\nB", "x .\ny", "٣ ½ ² a1b2", "  leading", "trail  ", "\r\n a\r\n", "a\x1c b", "▁a ▁▁ b", "<s> </s> <unk> <0x0A>"]
LETTERS = list("ab zé.,\n\n  '_1-s\t٣日 \x85<|▁>")
BYTES = ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def same_ids(text):
    assert np.frombuffer(BYTES.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ODD)
def test_tokens_of_odd_texts(text):
    same_ids(text)
    assert PIECES.count(text) == len(MODEL.encode(text))


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(LETTERS)))
def test_tokens_of_random_texts(text):
    same_ids(text)
    assert PIECES.count(text) == len(MODEL.encode(text))


def test_words_with_runs_of_marks_need_no_whole_encoding(monkeypatch):
    words = [f"wé{chr(0x61 + a)}{chr(0x61 + b)}" for a in range(20) for b in range(20)]
    texts = [" ".join(w + marks for w in words) for marks in ("###", ".&&&", "!!", "_'", ",")] + [" ".join(f"{k}%" for k in range(400))]
    encoder = ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked, library = [], encoder.library
    monkeypatch.setattr(encoder, "library", lambda text: (asked.append(text), library(text))[1])
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(asked) < 20


def test_shards_round_trip_and_notice_damage():
    rng = np.random.default_rng(1)
    for ids in [*(rng.zipf(1.2, n) % 50257 for n in (0, 1, 127, 129, 5000, 70000)), np.full(1000, 7), rng.integers(0, 2**32, 3000, dtype=np.uint64)]:
        ids = ids.astype(np.uint32)
        data = rans.encode_shard(ids)
        assert (rans.decode_shard(data) == ids).all()
    with pytest.raises(ValueError):
        rans.decode_shard(data[:-1] + bytes([data[-1] ^ 1]))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            sums = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and sums % 10 == 0) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1000, deadline=None)
@given(st.text(st.sampled_from(list("a@.@..12345678900+-( )4929348385146306"))))
def test_base_spans(text):
    assert [s[:3] for s in personal_data.find(text) if s[0] in BASE] == plain_spans(text)


def test_account_numbers_end_where_their_country_ends():
    found = lambda t: [t[a:b] for k, a, b, _ in personal_data.find(t) if k == "iban"]
    german, british = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    for behind in ("", " BIC COBADEFFXXX", " USA", ".", " 7", "\nNEXT LINE", f" {british}"):
        assert found(f"pay to {german}{behind}")[0] == german and found(f"x {british}{behind}")[0] == british
    assert found(f"account {german} {british} DE89370400440532013000") == [german, british, "DE89370400440532013000"]
    assert found("konto DE89 3704 0044 0532 0130 0") == found(f"konto {german}A") == found("A" + german) == found(german.lower()) == []
    # A country that is not in the list: the longest end that holds.
    number = next(f"XX{k:02d}ABCD12345678" for k in range(2, 99) if personal_data.mod97(f"XX{k:02d}ABCD12345678"))
    assert found(f"bank {number}") == [number]
    assert found("DE89" * 20000) == []


def test_added_spans_need_checks_and_context():
    kinds = lambda t: [s[0] for s in personal_data.find(t)]
    assert "iban" in kinds("pay to DE89 3704 0044 0532 0130 00 now") and "iban" not in kinds("pay to DE88 3704 0044 0532 0130 00 now")
    assert kinds("my ssn 123-45-6789") == ["tax"] and kinds("code 123-45-6789") == []


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    w, hit, ids = words(text), set(), set()
    for ident, item in items:
        iw = words(item)
        for k in range(max(1, len(iw) - 9) if iw else 0):
            p = iw[k:k + 10]
            for j in range(len(w) - len(p) + 1):
                if w[j:j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    ids.add(ident)
    return len(w), len(hit), ids


def test_hits():
    rng = np.random.default_rng(2)
    words = ["the", "of", "Re", "é", "a1", "longerword", "in"]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [("1", text(30)), ("2", text(12)), ("3", "Of the"), ("4", "..."), (None, "re in"), ("5", None), ("6", "é")]
    texts = ["", "..", "the", "Of the", items[0][1], "x " + items[1][1] + ". y", *(text(int(n)) for n in rng.integers(1, 80, 60))]
    for t, (n, hits, ids) in zip(texts, decontaminate.Benchmark(items).scan([t.encode() for t in texts])):
        assert (n, sum(hits[1::2]) - sum(hits[::2]), ids) == plain_hits(t, items)


def test_best_path_is_best():
    rng = np.random.default_rng(3)
    for _ in range(10):
        sizes, k = rng.integers(0, 400, 8), int(rng.integers(1, 6))
        scores = rng.normal(0, 2, (sizes.sum(), k))
        path, at = language_id.best_path(scores, sizes, 5.0), 0
        for n in sizes:
            s, p = scores[at:at + n], path[at:at + n]
            if n:
                value = s[0]
                for row in s[1:]:
                    value = np.maximum(value, value.max() - 5.0) + row
                assert abs(s[np.arange(n), p].sum() - 5.0 * (np.diff(p) != 0).sum() - value.max()) < 1e-6
            at += n


@pytest.mark.parametrize("width", [3, 5])
def test_shingle_sets(width):
    for t, s in zip(ODD, parity_join.shingle_sets([t.encode() for t in ODD], width)):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        assert len(s) == (len({tuple(w[i:i + width]) for i in range(len(w) - width + 1)}) if len(w) >= width else min(1, len(w)))


@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_share_a_key(num):
    rng, bands = np.random.default_rng(4), parity_join.Bands(num, 100, 10000)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 400)), dtype=np.uint64))
        kept = rng.permutation(a)[int(rng.integers(0, max(1, len(a) // 8))):]
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**64, int(rng.integers(0, max(1, len(a) // 10))), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert np.intersect1d(bands.keys(a), bands.keys(b)).size


def test_trie_with_spills():
    rng = np.random.default_rng(5)
    strings = [b"x" * int(rng.integers(0, 40)) + bytes(rng.integers(97, 99, int(rng.integers(0, 12))).astype(np.uint8)) for _ in range(800)]
    expected = {}
    for i, s in enumerate(strings):
        low, n = expected.get(s, (i, 0))
        expected[s] = (min(low, i), n + 1)
    for budget in (1 << 30, 20000, 1000):
        trie = exact_dedup.PatriciaTrie(budget)
        for i, s in enumerate(strings):
            trie.insert(s, i, 1, None)
            if trie.full() and not trie.spill():
                trie.budget *= 2
        assert {s: (i, n) for s, i, n, _ in trie.entries()} == expected


def test_wide_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for size, other, common in ((1, 1, 1), (1, 2, 1), (120, 130, 60), (1000, 1100, 900), (1020, 1030, 1020), (5000, 100, 50)):
        pool = np.unique(rng.integers(0, 2**64, size + other, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:size]), np.sort(pool[size - common:size - common + other])
        wide = [parity_join.wide_sketch(s) for s in (a, b)]
        assert parity_join.sketch_distance(*wide) <= len(np.setxor1d(a, b))
        assert parity_join.sketch_distance(*wide) == parity_join.sketch_distance(*wide[::-1])
        assert parity_join.sketch_distance(wide[0], wide[0]) == 0 and len(wide[0]) * 8 >= 2 * size


def test_numbers_are_no_letters():
    assert language_id.words_of("½ ² ① Ⅳ 12 m²s _É 一二") == ["m", "s", "é", "一二"]
    model = language_id.LanguageModel(["aa", "bb"], np.ones((2, 1 << language_id.BITS)), np.ones((2, len(language_id.SCRIPT_NAMES))))
    assert [r[0] for r in model.label(["½ ² 12", "½ a"])] == ["und", "aa"]


def test_linked_sets_meet_without_their_largest_buckets():
    """Whatever the order of the keys, and a common passage makes few buckets of sets that share nothing else."""
    rng, bands = np.random.default_rng(9), parity_join.Bands(80, 100, 10000)

    def kept(s, members):
        keys, leave = bands.keys_and_leave(s)
        out = []
        for odd in (0, 1):
            own = sorted(keys[leave % 2 == odd].tolist(), key=lambda k: (-members(k), k))
            out += own[int(leave[leave % 2 == odd].max(initial=0)) // 2:]
        return set(out)

    for n in (5, 30, 200, 900, 3000):
        for _ in range(20):
            s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([s[rng.permutation(len(s))[int(len(s) * 0.1) + 1:]], rng.integers(0, 2**64, int(len(s) * 0.1), dtype=np.uint64)]))
            both = len(np.intersect1d(s, b))
            if 100 * both >= 80 * (len(s) + len(b) - both):
                salt = int(rng.integers(1 << 62))
                assert kept(s, lambda k: (k ^ salt) % 7) & kept(b, lambda k: (k ^ salt) % 7)
    passage = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 2**64, 540, dtype=np.uint64)])) for _ in range(400)]
    members = Counter(k for s in sets for k in bands.keys(s).tolist())
    pairs = lambda counts: sum(c * (c - 1) for c in counts.values())
    assert pairs(members) > 0
    assert pairs(Counter(k for s in sets for k in kept(s, members.__getitem__))) * 20 < pairs(members)


def test_the_last_join_tells_long_sets_apart(spark):
    rng, rows, want = np.random.default_rng(10), [], []
    for n, m, both in ((1000, 1000, 0), (1000, 1000, 500), (1000, 1000, 960), (1000, 1100, 940), (300, 300, 290), (250, 300, 249), (250, 300, 40), (9000, 9000, 8900), (2000, 2100, 100)):
        common = rng.integers(0, 2**64, both, dtype=np.uint64)
        a, b = (np.sort(np.concatenate([common, rng.integers(0, 2**64, k - both, dtype=np.uint64)])) for k in (n, m))
        rows.append((len(want), n, m, *(parity_join.middle_sketch(x).tolist() for x in (a, b))))
        want.append(100 * both >= 80 * (n + m - both))
    df = spark.createDataFrame(rows, "i int, na bigint, nb bigint, ma array<bigint>, mb array<bigint>")
    near = parity_join._near(F.col("na"), F.col("nb"), F.col("ma"), F.col("mb"), 80, 100)
    assert [r.ok for r in df.select("i", near.alias("ok")).orderBy("i").collect()] == want
