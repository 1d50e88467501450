"""Turn repair, spelling variants and nearest vectors on odd small tables against plain restatements."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import multi_index, permuterm, turn_repair

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, cost string, conv string, rank string"


def key(row):
    return tuple((v is None, str(v)) for v in row)


# 11


def faults(rows):
    """(initial, fault) of (role, text) rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        again = (role, text) in seen
        seen.add((role, text))
        fault = "blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ".!?" else None
        out.append((role[:1], fault))
    return out


def cheapest(rows):
    """Least (cost, audit) by a walk over all states, and the roles it gives."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    made = {"": "u", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", ())}

    def inserted(states):
        todo = list(states)
        while todo:
            p = todo.pop()
            cost, audit, roles = states[p]
            q = made[p]
            new = (cost + 5, audit + "I", (*roles, ("user" if q == "u" else "assistant", "")))
            if q not in states or new[:2] < states[q][:2]:
                states[q] = new
                todo.append(q)
        return states

    states = inserted(states)
    for (role, text), (initial, fault) in zip(rows, faults(rows), strict=True):
        step = {}
        for p, (cost, audit, roles) in states.items():
            options = [(p, 2, "D", roles)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                q = made[p]
                options.append((q, 1 + extra, "R", (*roles, ("user" if q == "u" else "assistant", text))))
                if (p, initial) in after:
                    options.append((after[p, initial], extra, "K", (*roles, (role, text))))
            for q, c, edit, out in options:
                new = (cost + c, audit + edit, out)
                if q not in step or new[:2] < step[q][:2]:
                    step[q] = new
        states = inserted(step)
    cost, audit, roles = min((states[p] for p in ("", "a") if p in states), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in roles).encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else x
        h = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def plain_repair(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in damaged(rows):
        groups[conv].append((turn is not None, turn or 0, role, zlib.crc32(text.encode()), text))
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(groups[conv])
        turns = [t for there, t, *_ in own if there]
        pairs = [(role, text) for *_, role, _, text in own]
        kinds = faults(pairs)
        count = Counter(f for _, f in kinds)
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(kinds))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, *cheapest(pairs)))
    return sorted(out, key=key)


def repair(df):
    out = turn_repair.with_all(turn_repair.repaired(turn_repair.damaged(df)), df)
    return sorted((tuple(r) for r in out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=key)


def odd_turns():
    draw = random.Random(3)
    texts = ["Yes.", "No", " ", "", "What?", "Well then!", "x" * 50_000 + ".", None, "tail. \n", "été"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(draw.randrange(1, 9)):
            rows.append((conv, draw.choice([*range(12), None]), draw.choice(roles), draw.choice(texts)))
    rows += [(1000, t, "user" if t % 2 else "assistant", f"Turn {t % 90}.") for t in range(1000)]  # several chunks
    return rows + rows[:5]


def test_repair_of_odd_turns(spark):
    rows = odd_turns()
    df = spark.createDataFrame([(*r, "c", "v", "r") for r in rows], TURNS).repartition(7)
    assert repair(df) == plain_repair(rows)


def test_repair_over_runs_and_parts(spark, monkeypatch):
    """A conversation that several chunks, runs and parts hold gives what it gives in one."""
    monkeypatch.setattr(turn_repair, "CHUNK", 2)
    monkeypatch.setattr(turn_repair, "RUN", 4)
    rows = [r for r in odd_turns() if r[0] in (1000, 5, None)]
    assert repair(spark.createDataFrame([(*r, "c", "v", "r") for r in rows], TURNS)) == plain_repair(rows)


def test_repair_of_no_turns(spark):
    assert repair(spark.createDataFrame([], TURNS)) == []
    # the hash drops both rows of conversation 11
    drops = [(c, t) for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:1]
    found = repair(spark.createDataFrame([(*drops[0], "user", "Hello.", "c", "v", "r")], TURNS))
    assert found == [(drops[0][0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("seed", range(30))
def test_halves_give_the_full_chart(seed):
    """Cells over every split of every span, as the chart has them, equal those of the halves."""
    draw = random.Random(seed)
    codes = [draw.choice("uasoUASO1234") for _ in range(draw.randrange(1, 12))]
    chart = {(i, i + 1): turn_repair._row(c) for i, c in enumerate(codes)}
    for length in range(2, len(codes) + 1):
        for i in range(len(codes) - length + 1):
            ways = [turn_repair.combined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
            assert len(set(ways)) == 1
            chart[i, i + length] = ways[0]
    assert chart[0, len(codes)] == turn_repair.parse([turn_repair._row(c) for c in codes])


# 12


def plain_words(rows, damage=31, letters=7):
    found = Counter()
    for name, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % damage == 0 else run
                if len(word) >= letters:
                    found[word] += 1
            run = ""
    return found


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: sorted((-m, v) for v, m in counts.items() if is_near(w, v)) for w in counts}
    form = {w: x[0] for w, x in near.items() if x and -x[0][0] >= 10 * counts[w]}
    out = []
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root][1]
        own = form.get(word)
        out.append((word, n, len(near[word]), own and own[1], own and -own[0], root))
    return sorted(out, key=key)


def variants(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted((tuple(r) for r in permuterm.variants(words).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=key)


def test_words_of_odd_rows(spark, loose, empty):
    rows = [(r[0], r[1]) for r in loose.select("doc_id", "text").collect()]
    long = [(i, f"Erstaunlich erstaunlich ÉTUDIANTE ×straße÷ {'lang' * 3000} {'lang' * 3000}, {'letter' * 20}s") for i in range(80)]
    both = [*rows, *long]
    df = spark.createDataFrame(both, "doc_id long, text string")
    found = {r["word"]: r["n"] for r in permuterm.lettered_words(df, 31, 7).collect()}
    assert found == dict(plain_words(both)) and any(len(w) == 11_999 for w in found)
    assert permuterm.lettered_words(empty, 31, 7).collect() == []
    assert variants(spark, {}) == []


def test_variants_against_all_pairs(spark):
    draw = random.Random(8)
    counts = {"".join(draw.choice("ab") for _ in range(draw.randrange(3, 8))): draw.choice([1, 1, 2, 3, 10, 10, 30, 200, 4000]) for _ in range(400)}
    counts |= {"été": 5, "étés": 50, "aaaa": 3, "aaaaa": 30, "aaaaaa": 300, "aaaaaaa": 3000}
    assert variants(spark, counts) == plain_variants(counts)


def test_variants_of_long_words(spark):
    """Hashed prefixes, where words cross the border to them and beyond."""
    draw = random.Random(9)
    counts = {}
    for n in (permuterm.LONG - 1, permuterm.LONG, permuterm.LONG + 1, permuterm.LONG + 2, 300):
        base = "".join(draw.choice("abc") for _ in range(n))
        counts[base] = 1000
        for i in (0, 1, n // 2, n - 1):
            counts[base[:i] + base[i + 1 :]] = draw.randrange(2, 9)
            counts[base[:i] + "z" + base[i + 1 :]] = draw.randrange(2, 9)
            counts[base[:i] + "y" + base[i:]] = draw.randrange(2, 9)
    assert variants(spark, counts) == plain_variants(counts)


def test_a_long_run_makes_short_rows():
    made = list(permuterm.hashed_prefixes("ab" * 5000))
    assert len(made) == 20_001 and max(len(p) for p, *_ in made) < 50


# 13

VECTORS = "vec_id long, embedding array<float>, label int, id string, code string, block string, vector string"


def vector_rows(n, width, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)).astype(np.float32)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def found(df, k=20):
    out = multi_index.nearest(multi_index.usable(df), F.col("id") % 20 == 0, k)
    groups = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        groups[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return groups


def brute(rows, k=20):
    out = {}
    for name, vector in rows:
        if name % 20 == 0:
            scored = sorted((-float((np.float64(v) * np.float64(vector)).sum()), n) for n, v in rows if n != name)[:k]
            out[name] = [(i + 1, n, -s) for i, (s, n) in enumerate(scored)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(n, None if v is None else [None if x is None else float(x) for x in v], 1, "i", "c", "b", "v") for n, v in rows], VECTORS)


def recall(got, want):
    return sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want) / sum(map(len, want.values()))


def test_fewer_candidates_than_asked_for_are_all_found(spark):
    rows = [(i, v) for i, v in enumerate(vector_rows(15, 8, 1))]
    got = found(frame(spark, rows))
    want = brute(rows)
    assert {q: [x[:2] for x in r] for q, r in got.items()} == {q: [x[:2] for x in r] for q, r in want.items()}


def test_unusable_vectors_ties_and_repeated_rows(spark):
    base = vector_rows(300, 12, 2)
    rows = [(i, v) for i, v in enumerate(base)]
    copies = [(1000 + i, base[0]) for i in range(40)]  # more ties than are asked for
    bad = [(2000, None), (2020, np.zeros(12)), (2040, [None, *base[1][1:]]), (2060, [float("nan"), *base[1][1:]]), (2080, [float("inf"), *base[1][1:]]), (2100, base[1][:5]), (2120, [])]
    df = frame(spark, [*rows, *copies, *bad, *rows[:60]])
    got, want = found(df), brute([*rows, *copies])
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, own in got.items():
        assert len(own) == 20 and [x[0] for x in own] == list(range(1, 21)) and own == sorted(own, key=lambda x: (-x[2], x[1]))
        exact = {n: s for _, n, s in want[q]}
        assert all(abs(s - exact[n]) < 1e-12 for _, n, s in own if n in exact)
    assert [x[1] for x in got[0]] == list(range(1000, 1020))


def test_no_vectors(spark):
    assert found(frame(spark, [])) == {} == found(frame(spark, [(0, None), (20, [0.0, 0.0])]))
    assert found(frame(spark, [(20, [1.0, 2.0])])) == {}


def test_lengths_matter(spark):
    """Products, not angles: a long vector beats a nearer short one."""
    base = vector_rows(400, 16, 3) * np.linspace(0.2, 1.0, 400, dtype=np.float32)[:, None]
    rows = [(i, v) for i, v in enumerate(base)]
    assert recall(found(frame(spark, rows)), brute(rows)) >= 0.9


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 150)
    rows = [(i, v) for i, v in enumerate(vector_rows(1000, 64, 4))]
    assert recall(found(frame(spark, rows)), brute(rows)) >= 0.9


@pytest.mark.parametrize("radius", [0, 3, 7, 8, 20, 64])
def test_probing_finds_every_code_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    near = codes[:250] ^ (np.uint64(1) << rng.integers(0, 64, 250, dtype=np.uint64))
    codes = np.concatenate([codes, near, codes[:50]])
    block = multi_index.Block(np.arange(len(codes)), codes, np.ones((len(codes), 4)))
    for code in codes[::37]:
        assert block.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code) <= radius).tolist()


def test_recall_of_the_query(spark):
    from touchline.llm.queries import QUERIES

    df = QUERIES["op13_multi_index_neighbours"](spark, "/root/testdata/sf0.01")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in df.collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert recall(got, brute(rows)) >= 0.9
