"""Spelling variants, multivariate outliers and conversation repair against brute force, and their odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evidara.llm import outliers, turn_repair, variants
from tests.llm.conftest import ODD, sentence

rnd = random.Random(11)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- spelling variants


def edits(word, alphabet):
    """All distinct words at one edit, plainly."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + a + word[i + 1 :] for i in range(len(word)) for a in alphabet}
    out |= {word[:i] + a + word[i:] for i in range(len(word) + 1) for a in alphabet}
    return out - {word}


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_neighbourhoods(monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    words, alphabet = ["aab", "abc", "bbb", "a", "ccabca", "日本é"], "abcé日本"
    signs = np.array([ord(c) for c in alphabet], np.uint32)
    assert len(set(variants.word_hashes(words).tolist())) == len(words)
    for w in words:
        codes = np.array([[ord(c) for c in w]], np.uint32)
        found = [x for _, _, _, h in variants.neighbours(codes, signs) for x in h.reshape(-1).tolist() if x]
        wanted = variants.word_hashes(sorted(edits(w, alphabet) - {""}))
        assert sorted(found) == sorted(wanted.tolist())  # each distinct edit once


def plain_counts(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 5}


def plain_groups(count):
    near = {w: edits(w, "abcdefghijklmnopqrstuvwxyzäöüéß") & count.keys() for w in count}
    form = {w: min((x for x in near[w] if count[x] >= 5 * count[w]), key=lambda x: (-count[x], x), default=None) for w in count}
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return sorted(out)


def test_variants_against_brute_force(spark):
    base = ["garden", "gardens", "garten", "straße", "Müller", "wünsche", "aaaaaa", "aaaaaaa", "aaaaaaaa", "Garden", "letter", "better"]
    texts = [" ".join(rnd.choice(base[: 3 + i % 10]) + rnd.choice(["", "", ",", " x", "ß"]) for _ in range(200)) for i in range(40)] + [" gardén×" * 5, "gardem-" * 7, "Überaus " * 300, "überauß " * 5, "Überaux " * 30]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    counts = plain_counts(rows)
    assert len(counts) > 15
    got = variants.variant_groups(variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == plain_groups(counts)


def test_roots_of_a_long_chain(spark):
    names = ["abcdefgh" + "x" * k for k in range(9)]
    got = variants.variant_groups(spark.createDataFrame([(w, 5**k) for k, w in enumerate(names)], "word string, n long")).collect()
    assert {r["word"]: r["root"] for r in got} == dict.fromkeys(names, names[-1])
    assert {r["word"]: r["n_near"] for r in got} == {w: 2 if 0 < k < 8 else 1 for k, w in enumerate(names)}


def test_variants_full_filter_and_odd_cases(spark, odd, none, monkeypatch):
    words = spark.createDataFrame([("".join(rnd.choice("abc") for _ in range(6)), 7) for _ in range(200)], "word string, n long").distinct()
    monkeypatch.setattr(variants, "_filter_bits", lambda n: 1 << 3)  # a filter that lets everything through
    assert sorted(map(tuple, variants.variant_groups(words).collect())) == plain_groups({r["word"]: 7 for r in words.collect()})
    monkeypatch.undo()
    assert variants.variant_groups(variants.word_counts(none)).collect() == []
    found = {r["word"] for r in variants.word_counts(odd).collect()}
    assert found == set(plain_counts([*enumerate(ODD), (4, ODD[4]), (12, ODD[12]), (None, "no id here")]))


# ---- outliers


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


NOISE = ["".join(rnd.choice("aB é|#\n\t日.") for _ in range(rnd.randrange(0, 200))) for _ in range(80)]
REPEATS = ["a b c d e\nx\na b c d e\n\n \nx\r\nx\nx", "a a a a a a", "one two three four five\n" * 3, "\n\n\n", "é" * 300 + "\n" + "é" * 300]


def test_rule_counts():
    texts = ODD + NOISE + REPEATS
    found = outliers.rule_counts(pa.array(texts))
    assert list(zip(*(found[c].tolist() for c in outliers.COUNTS))) == [plain_rules(t) for t in texts]


def plain_estimate(x, share, seed=0):
    """FAST-MCD with random starts and whole subsets of the nearest rows, then one reweighting."""
    rng, d, floor = np.random.default_rng(seed), x.shape[1], np.diag(outliers.FLOOR**2)
    far = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    h, best = int(share * len(x)), None
    factor = share / outliers.chi_square(outliers.chi_square_point(share, d), d + 2)
    for _ in range(30):
        own = x[rng.choice(len(x), d + 1, replace=False)]
        m, s = own.mean(0), np.cov(own.T, bias=True) + floor
        for _ in range(30):
            near = x[np.argsort(far(m, s), kind="stable")[:h]]
            m, s = near.mean(0), factor * np.cov(near.T, bias=True) + floor
        if best is None or np.linalg.slogdet(s)[1] < best[0]:
            best = (np.linalg.slogdet(s)[1], m, s)
    limit = outliers.chi_square_point(0.975, d)
    near = x[far(*best[1:]) <= limit]
    return far(near.mean(0), 0.975 / outliers.chi_square(limit, d + 2) * np.cov(near.T, bias=True) + floor)


def prose(i):
    return " ".join(sentence(i * 31 + k, 6 + (i + k) % 9) for k in range(2 + i % 13))


def junk(i):
    return " ".join("".join(rnd.choice("abcdef") for _ in range(4)).upper() + rnd.choice(["###", "$$$ |", "!!"]) for _ in range(30 + i))


def test_outliers_against_plain_estimates(spark):
    rows = [(i, prose(i), "en", f"s{i % 2}") for i in range(300)] + [(300 + i, junk(i), "en", f"s{i % 2}") for i in range(40)]
    rows += [(400 + i, prose(7), "en", "s0") for i in range(150)]  # copies, as many as the others of their group
    rows += [(600 + i, prose(i) + " more", "de", f"small{i % 30}") for i in range(60)] + [(700, junk(3), "de", "small1"), (701, junk(4), "xx", "alone")]
    got = {r["doc_id"]: r for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).collect()}
    assert len(got) == len(rows)
    pools = defaultdict(list)
    for i, text, lang, source in rows:
        assert tuple(got[i][c] for c in outliers.COUNTS) == plain_rules(text)
        n, repeats = got[i]["n_words"], got[i]["n_repeat_words"]
        assert got[i]["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        if not got[i]["base_failed"]:
            counts = outliers.rule_counts(pa.array([text]))
            pools[lang if lang != "en" else source].append((i, outliers.vectors(counts)[0]))
        else:
            assert not got[i]["kept"]
    for name, own in pools.items():
        distinct = np.unique(np.array([v for _, v in own]), axis=0)
        if len(distinct) < outliers.LEAST:
            assert all(got[i]["distance"] is None and got[i]["kept"] for i, _ in own)
            continue
        wanted = {v.tobytes(): d for v, d in zip(distinct, plain_estimate(distinct, outliers.SHARE))}
        for i, v in own:
            assert got[i]["kept"] == (wanted[v.tobytes()] <= outliers.CUTOFF), (name, i)
            assert got[i]["distance"] == pytest.approx(wanted[v.tobytes()], rel=0.25, abs=2.0)
    assert all(not got[i]["kept"] for i in (*range(300, 340), 700)) and got[701]["kept"]
    assert sum(not got[i]["kept"] for i in (*range(300), *range(400, 550), *range(600, 660)) if not got[i]["base_failed"]) == 0


def test_chi_square():
    assert outliers.chi_square_point(0.975, 8) == pytest.approx(17.5345, abs=1e-3)
    assert outliers.chi_square(9.34182, 10) == pytest.approx(0.5, abs=1e-4)


def test_outliers_odd_cases(spark, odd, none):
    assert outliers.judge(none).collect() == []
    rows = outliers.judge(odd).collect()
    assert len(rows) == len(ODD) + 3
    assert {r["doc_id"]: tuple(r[c] for c in outliers.COUNTS) for r in rows if r["doc_id"] is not None} == {i: plain_rules(t) for i, t in enumerate(ODD)}
    assert all(r["kept"] != r["base_failed"] for r in rows)  # too few to estimate from


# ---- conversations


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired lines) by trying all edits turn after turn, least first for each state."""
    best = {"": (0, "", ())}  # a state: what the last turn was

    def put(at, state, entry):
        if state not in at or entry < at[state]:
            at[state] = entry

    def inserted(at):
        for _ in range(3):
            for state, (c, a, lines) in list(at.items()):
                role = "assistant" if state == "u" else "user"
                put(at, role[0], (c + 5, a + "I", (*lines, f"{role}:")))
        return at

    best = inserted(best)
    for role, text, gone, cut in turns:
        fresh = {}
        for state, (c, a, lines) in best.items():
            put(fresh, state, (c + 2, a + "D", lines))
            if not gone:
                right = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                if role[:1] and role[0] in right:
                    put(fresh, role[0], (c + 5 * cut, a + "K", (*lines, f"{role}:{text}")))
                other = "assistant" if state == "u" else "user"
                put(fresh, other[0], (c + 1 + 5 * cut, a + "R", (*lines, f"{other}:{text}")))
        best = inserted(fresh)
    return min(best[s] for s in ("", "a") if s in best)


def plain_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults, turns = set(), Counter(), []
        for _, _, role, text in own:
            body = "".join(WORD.findall(text))
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = {r[1] for r in own if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, lines = cheapest(turns)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(convs, longest):
    rows = []
    for c in range(convs):
        turn = 0
        for _ in range(rnd.randrange(0, longest)):
            turn += rnd.choice([1, 1, 1, 2, 3])
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            rows.append((c, rnd.choice([turn, turn, None]), role, rnd.choice([None, "", " \n", "Yes.", "no", "Why? ", "x" * 50 + "!\n", "Ä.ö", "fine"]) if rnd.random() < 0.5 else sentence(turn + c)))
    return [*rows, *rows[:5], (None, 0, "user", "Hello."), (None, 1, "assistant", "Hi!"), (10**12, 1, "system", "s.")]


@pytest.mark.parametrize("part", [2, 5, 4096])
def test_repair_against_brute_force(spark, part):
    rows = talk(40, 14) + [(99, k, "user" if k % 2 else "assistant", sentence(k) if k % 7 else "cut") for k in range(300)]
    df = spark.createDataFrame([(*r, None) for r in rows], "conv_id long, turn long, role string, text string, place int").repartition(4)
    got = turn_repair.repair(df, part_turns=part).collect()
    wanted = plain_repair(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == wanted and len(got) == len(wanted)


def test_automaton_has_few_states():
    machine = turn_repair.CostAutomaton()
    for _ in range(300):
        machine.scan("".join(rnd.choice("xsuaoSUAO") for _ in range(rnd.randrange(60))), turn_repair._END)
    assert len(machine.vectors) < 200


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(empty).collect() == []
    gone = next(k for k in range(100) if zlib.crc32(f"7:{k}".encode()) % 20 == 0)
    row = turn_repair.repair(spark.createDataFrame([(7, gone, "user", "Gone.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in row] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
