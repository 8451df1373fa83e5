"""Line cleaning, Merkle manifest and conversation repair against plain Python on small tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from pactlens.llm import conversation_repair, line_cleaning, merkle

SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- line cleaning


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def base_measures(text):
    text = text or ""
    words, lines = split(text), [l for l in text.split("\n") if split(l)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def test_line_cleaning(spark):
    rng = random.Random(5)
    good = "Fox %d was %d years old, and it ran %d miles to %d more towns."
    texts = [None, "", " \n\t", "one two.", "a a a a a a a a a", " ".join("abcde"[i % 5] for i in range(60)), "é " * 30 + ".",
             "\n".join(good % (i, i + 9, i + 40, i + 80) for i in range(4)) + "\nAll rights reserved.\nHome | News | Contact | Help\nno end here\n\nSkip to content",
             "\n".join(good % (i, i + 9, i + 40, i + 80) for i in range(4)) + "\n" + " ".join(f"wh{i}### on&&&" for i in range(60)), "LOUD!! NOISE!! " * 15, "one\x0btwo\x0cthree\rfour. " * 9]
    texts += [" ".join(rng.choices("ab", k=rng.randrange(8, 60))) + ".\n" + "x y. \nx y. " for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "1 as cleaning", "2 as _words")
    report = line_cleaning.with_cleaning(docs)
    assert set(docs.columns) <= set(report.columns)
    got = {r["doc_id"]: r["cleaning_"] for r in report.collect()}
    for i, text in enumerate(texts):
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == base_measures(text), text
        assert not (g["kept"] and g["base_failed"])
    assert got[7]["cleaned_text"] == "\n".join(good % (i, i + 9, i + 40, i + 80) for i in range(4)) + "\n" and got[7]["kept"]
    assert (got[7]["n_boilerplate"], got[7]["n_navigation"], got[7]["n_punctuation"]) == (1, 2, 1)
    assert not got[8]["kept"] and not got[8]["base_failed"] and got[9]["n_punctuation"] == 1
    assert line_cleaning.with_cleaning(docs.limit(0)).count() == 0
    kept = line_cleaning.cleaned(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, g in got.items() if g["kept"]}


def test_line_cleaning_of_a_long_text(spark):
    lines = [f"Line {i} of a text of {i * 3} words, see {i * 7}." for i in range(30_000)]
    row = line_cleaning.with_cleaning(spark.createDataFrame([("\n".join(lines),)], "text string")).first()["cleaning"]
    assert row["kept"] and row["n_repeat_words"] == 0 and row["n_words"] == 10 * len(lines)


# -- Merkle manifest


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); the contract, one list at a time."""
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(nodes):
        """Root, and per leaf (siblings before, after) per level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k:k + 8] for k in range(0, len(nodes), 8)]
            for path, q in zip(paths, at):
                run = runs[q // 8]
                path.append(("".join(run[:q % 8]), "".join(run[q % 8 + 1:])))
            at, nodes = [q // 8 for q in at], [sha("".join(r)) for r in runs]
        return nodes[0], paths

    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    langs = sorted({r[2] for r in rows}, key=lambda l: (l is not None, (l or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, *climb([leaf(r) for r in own])
    root, tops = climb([trees[l][1] for l in langs])
    for lang, top in zip(langs, tops):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf((*r[:4], low(r[4]))) if tampered else leaf(r)
            for before, after in path + top:
                folded = sha(before + folded + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(b + a for b, a in path + top)), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [3], [9, 1], [70, 8, 65], [600, 1, 2, 3, 4, 5, 6, 7, 8, 513]])
def test_manifest(spark, sizes):
    rows = []
    for k, n in enumerate(sizes):
        lang = None if k == 1 else f"l{k}" if k % 2 else f"é{k}"
        rows += [(i * 3 + k, None if i % 7 == 0 else "web", lang, i, None if i % 11 == 5 else f"Text {i} É" if i % 2 else f"low {i}") for i in range(n)]
    if len(sizes) > 2:
        rows += [(None, None, None, None, None), rows[0], rows[0], (rows[0][0], "other", rows[0][2], 1, "Twin")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").selectExpr("*", "1 as leaf", "2 as pos", "3 as tree")
    want = brute_manifest(rows)
    for span in (8, 512):
        got = merkle.manifest(docs.repartition(5), span=span).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    proven = merkle.manifest(docs, with_proof=True).collect()
    assert all(sha(r["proof"]) == r["proof_sha256"] for r in proven)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")).collect() == []


def test_missing_places_are_the_least(spark):
    parts = spark.createDataFrame([("t", 0, 10, 20, 100), ("t", 1, 0, 99, 100), ("t", 2, 64, 64, 65)], "tree string, part bigint, lo bigint, hi bigint, total bigint")
    got = {}
    for r in merkle.missing_places(parts).collect():
        got.setdefault(r["part"], set()).add((r["level"], r["pos"]))
    assert got == {0: {(0, 8), (0, 9), (0, 21), (0, 22), (0, 23), *[(1, p) for p in (0, 3, 4, 5, 6, 7)], (2, 1)}, 2: {(2, 0)}}


# -- conversation repair


def brute_repair(rows):
    """rows: (turn, role, text, fault) in order; least cost, then least string, by a search over whole edit strings."""
    following = {0: "su", 1: "u", 2: "a", 3: "u"}
    state_after = {"s": 1, "u": 2, "a": 3}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, edits, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, edits, sha("\n".join(f"{r}:{t}" for r, t in made))
        if (i, state) in done:
            continue
        done.add((i, state))
        for c in following[state]:
            if c != "s":
                heapq.heappush(heap, (cost + 5, edits + "I", i, state_after[c], (*made, (names[c], ""))))
        if i < len(rows):
            _, role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state, made))
            if fault in (None, "truncated"):
                late = 5 * (fault == "truncated")
                for c in following[state]:
                    if role[:1] == c:
                        heapq.heappush(heap, (cost + late, edits + "K", i + 1, state_after[c], (*made, (role, text))))
                    if c != "s":
                        heapq.heappush(heap, (cost + late + 1, edits + "R", i + 1, state_after[c], (*made, (names[c], text))))


def brute_audit(rows):
    """rows: (turn, role, text), damaged, nulls filled."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    cost, edits, digest = brute_repair([(*r, f) for r, f in zip(rows, faults)])
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, digest


def brute_damage(rows):
    out, shown = {}, lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text, how = shown(role), shown(text), zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        row = (turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
        kept += [] if how == 0 else [row] * (2 if how == 3 else 1)
    return out


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(11), []
    for conv in range(250):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choices(["system", "user", "assistant", "tool", "", None], [1, 5, 5, 1, 0.3, 0.3])[0]
            text = rng.choices([f"Words {turn}.", "Same again!", "cut off", " \t", "", None, "Ends? \n"], [8, 2, 2, 0.5, 0.5, 0.5, 1])[0]
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1]), role, text))
    return rows + rows[:40]


def test_conversations(spark, talks):
    rows = spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as pos", "2 as fault", "3 as cost")
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.audited_all(rows, conversation_repair.damaged(rows.repartition(7))).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", sha(""))
    want = {c: brute_audit(rs) if rs else empty for c, rs in brute_damage(talks).items()}
    assert got == want
    edits = {}
    for r in sorted(conversation_repair.repaired(conversation_repair.damaged(rows)).where("place is not null").collect(), key=lambda r: r["place"]):
        edits.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: sha("\n".join(v)) for c, v in edits.items()} == {c: w[7] for c, w in want.items() if w[7] != sha("")}


def test_conversations_without_rows(spark):
    rows = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_repair.audited_all(rows, conversation_repair.damaged(rows)).collect() == []


def test_a_long_conversation_is_repaired_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Good one %d." % t, "Good.", "cut"])) for t in range(3000)]
    monkeypatch.setattr(conversation_repair, "LEAST_BLOCK", 5)
    got = conversation_repair.audited(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [tuple(r[1:]) for r in got] == [brute_audit([r[1:] for r in rows])]
