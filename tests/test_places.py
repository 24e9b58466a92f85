"""Positions, lock-step validation, serial quotas, percentiles and detection against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import audit, matching, metrics, planning, positions


def test_positions_of_a_large_table(spark, tmp_path):
    """3,000,000 rows in 12 files, with other columns beside the order."""
    n = 3_000_000
    spark.range(n).select((F.col("id") * 7 % n).alias("x"), F.col("id").alias("was")).repartition(12).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    got = positions.positional(rows, ["x"], "n")
    assert got.count() == n and got.where("n <> x + 1 OR was * 7 % 3000000 <> x").isEmpty()
    zipped = positions.zip_by_position(rows, ["x"], rows.select((-F.col("x")).alias("y"), F.col("was").alias("other")), ["y"])
    assert zipped.count() == n and zipped.where(f"-y <> {n - 1} - x").isEmpty()


def test_positions_in_groups(spark):
    """A group that holds nearly all rows, a null group and one of a single row."""
    rows = spark.range(50_000).select("id", F.when(F.col("id") == 7, "one").when(F.col("id") % 100 == 3, F.lit(None)).otherwise("hot").alias("g"))
    seen = {}
    for r in sorted(positions.positional_within(rows, ["g"], ["id"], "k").collect(), key=lambda r: r.id):
        seen[r.g] = seen.get(r.g, 0) + 1
        assert r.k == seen[r.g]
    assert sorted(map(str, seen)) == ["None", "hot", "one"]


def test_positions_of_nothing(spark):
    assert positions.positional(spark.range(0), ["id"], "n").count() == 0
    with pytest.raises(ValueError, match="3 rows against 2"):
        positions.zip_by_position(spark.range(3), ["id"], spark.range(2).withColumnRenamed("id", "x"), ["x"])


def walk(plan, metadata, manifests, bad):
    """One row after another, as a reader of three files would."""
    metadata, lists, seen, out, good = iter(metadata), {s: iter(rows) for s, rows in manifests.items()}, set(), [], []
    for place, (_, i, split, text) in enumerate(plan, 1):
        meta = next(metadata, None)
        if meta is None or meta[1:] != (i, split, text):
            out.append((place, i, "metadata ended" if meta is None else "metadata disagrees"))
            continue
        said = next(lists.get(split, iter(())), None)
        if said is None or said != text:
            out.append((place, i, "manifest ended" if said is None else "manifest disagrees"))
        elif text == bad:
            out.append((place, i, "bad"))
        elif i in seen:
            out.append((place, i, "duplicate id"))
        else:
            seen.add(i)
            good.append(place)
    left = len(list(metadata))
    if left:
        out.append((len(plan) + 1, None, "extra rows in metadata"))
    return out, good, {s for s, rows in lists.items() if next(rows, None) is not None}


@pytest.mark.parametrize("seed", range(4))
def test_lock_step(spark, seed):
    rng = random.Random(seed)
    plan = [(k, rng.choice([k, k, k, rng.randrange(300)]), rng.choice(["train", "test", None]), rng.choice("abcd")) for k in range(300)]
    metadata = [(k, i, s, "?" if rng.random() < 0.03 else t) for k, i, s, t in plan][: rng.choice([280, 300])] + ([(400, 1, "train", "a")] if seed % 2 else [])
    agreed = [p for p, m in zip(plan, metadata, strict=False) if p == m]
    manifests = {s: ["!" if rng.random() < 0.05 else t for _, _, x, t in agreed if x == s] for s in ("train", "test", None)}
    manifests["train"] += ["more"] * (seed % 3)
    manifests["test"] = manifests["test"][: len(manifests["test"]) - seed]
    manifests["unplanned"] = ["x"]
    wanted, good, extra = walk(plan, metadata, manifests, "d")
    frame = lambda rows: spark.createDataFrame(rows, "k long, id long, split string, text string").repartition(5)
    listed = spark.createDataFrame([(k, s, t) for s, rows in manifests.items() for k, t in enumerate(rows)], "k long, split string, text string")
    problems, fine = positions.lock_step(frame(plan), frame(metadata), listed, ["k"], ["id", "split", "text"], ["text"], [positions.Rule("bad", F.col("text") == "d")])
    got = [tuple(r) for r in problems.collect()]
    rest = [x for x in got if x[2].startswith("extra rows in ") and x[2] != "extra rows in metadata"]
    assert sorted((x for x in got if x not in rest), key=str) == sorted(wanted, key=str)
    assert {x[2].removeprefix("extra rows in ") for x in rest} == {str(s) if s else "null" for s in extra}
    assert sorted(r.place for r in fine.collect()) == good
    firsts = {r.problem: (r.n, r.place) for r in positions.first_difference(problems).collect()}
    assert all(firsts[p] == (sum(x[2] == p for x in got), min(x[0] for x in got if x[2] == p)) for p in {x[2] for x in got})


def serial(rows, quota, cap):
    """Group after group, row after row."""
    used, out = set(), []
    for g in sorted({r[0] for r in rows}):
        taken = special = 0
        for _, text, is_special, _ in sorted((r for r in rows if r[0] == g), key=lambda r: r[3]):
            if taken == quota or text in used or (is_special and special >= cap):
                continue
            used.add(text)
            taken, special = taken + 1, special + is_special
            out.append((g, taken, text))
    return out


@pytest.mark.parametrize(("groups", "texts", "quota", "cap"), [(6, 40, 5, 2), (8, 20, 4, 1), (5, 12, 6, 0), (3, 200, 10, 3)])
def test_serial_quotas(spark, groups, texts, quota, cap):
    """Texts that most groups want, also twice in a group as a capped and as another one."""
    rng = random.Random(groups * texts)
    rows = [(rng.randrange(groups), f"t{rng.randrange(texts)}", rng.random() < 0.4, k) for k in rng.sample(range(100_000), 300)]
    frame = spark.createDataFrame(rows, "g long, text string, special boolean, h long")
    got = planning.select_quota(frame, ["g"], F.lit(quota), ["h"], F.col("special"), F.lit(cap))
    wanted = serial(rows, quota, cap)
    assert sorted((r.g, r.rank, r.text) for r in got.collect()) == sorted(wanted)
    short = [g for g in range(groups) if sum(x[0] == g for x in wanted) != quota]
    assert sorted(r.g for r in planning.unmet(got, frame, ["g"], F.lit(quota)).collect()) == short
    if short:
        with pytest.raises(ValueError, match="too few"):
            planning.require_quota(got, frame, ["g"], F.lit(quota))


def test_percentiles_are_exact(spark):
    """Beyond what needs no sketch: a large group, one of few distinct values, small ones, none, and a null group."""
    rng = np.random.Generator(np.random.PCG64(1))
    groups = {"large": rng.lognormal(0, 3, 120_000) * rng.choice([-1, 1], 120_000), "few": rng.integers(0, 4, 40_000).astype(float), "one": np.array([2.5]), "two": np.array([1.0, 4.0]), None: rng.normal(size=11_000), "none": np.array([np.nan])}
    rows = [(g, float(x)) for g, values in groups.items() for x in values] + [("none", None), ("two", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(7)
    qs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r.g: r for r in metrics.with_percentiles(frame, ["g"], {"x": F.col("x"), "y": -F.col("x")}, {f"{v}{k}": (v, q) for v in "xy" for k, q in enumerate(qs)}, [F.count("*").alias("n")]).collect()}
    assert len(got) == len(groups)
    for g, values in groups.items():
        for k, q in enumerate(qs):
            wanted = (None, None) if g == "none" else (np.quantile(values, q), np.quantile(-values, q))
            assert (got[g][f"x{k}"], got[g][f"y{k}"]) == (wanted if g == "none" else pytest.approx(wanted, rel=1e-12, abs=1e-12))


@pytest.mark.parametrize("limit", [matching.BROADCAST_BYTES, 0])
def test_detection_by_the_rarest_token(spark, limit):
    """With a broadcast index and without; forms of frequent tokens, repeated tokens, unknown ones, and one inside another."""
    rng = random.Random(2)
    texts = [(k, " ".join(rng.choice("aabbccd") for _ in range(rng.randrange(0, 25)))) for k in range(200)] + [(900, None), (901, "a rare b")]
    forms = list(enumerate(["a", "a b", "a a a", "d c", "rare", "a rare b", "zzz", "a zzz", "", "b c d a", "a b a b"])) + [(3, "c d")]
    frame = spark.createDataFrame(texts, "id long, norm string")
    got = matching.positions(frame, spark.createDataFrame(forms, "form_id long, form string"), limit)
    wanted = []
    for i, text in texts:
        words = (text or "").split(" ") if text else []
        for f, form in forms:
            own = form.split(" ")
            wanted += [(i, f, p, len(own)) for p in range(len(words) - len(own) + 1) if form and words[p : p + len(own)] == own]
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)


@pytest.mark.parametrize("span", [3, audit.LEAK_SPAN])
def test_leaks_across_spans(spark, span):
    """A value in most rows, one of a single split, null, and one that comes back much later."""
    rng = random.Random(5)
    rows = [(k, rng.choice(["hot", "hot", "hot", "x", None]), rng.choice(["train", "test"])) for k in range(200)] + [(1000, "x", "train"), (2000, "x", "test"), (2001, "pure", "test"), (2005, "pure", "test")]
    seen, wanted = {}, []
    for k, v, s in rows:
        if v is not None and seen.get(v, s) != s:
            wanted.append((k, s, seen[v]))
        seen[v] = s
    got = audit.leakage(spark.createDataFrame(rows, "k long, v string, split string"), F.col("v"), "split", "k", span)
    assert sorted((r.k, r.split, r.before) for r in got.collect()) == wanted


def test_tolerant_positions_in_long_texts(spark):
    """Names at every border of the pieces that a text is cut into; what is verified is a piece and not the text."""
    import re


    match = lambda a, b: min(len(a), len(b)) > 0 and a[: (k := min(min(len(a), len(b)), max(3, min(len(a), len(b)) - 2)))] == b[:k]
    filler = [("word", "садовой", "улицы")[k % 7 % 3] for k in range(400)]
    texts = [(1, " ".join(filler)), (2, ""), (3, "садовая"), (4, " ".join("садовой улице" for _ in range(100)))]
    for k, at in enumerate((62, 63, 64, 65, 126, 127, 128, 398)):
        words = [f"слово{j}" for j in range(400)]
        words[at : at + 2] = ["садовой", "улице"]
        texts.append((10 + k, " ".join(words[:400])))
    for names in ([(1, "садовая улица"), (2, "улица садовая"), (3, "садовая"), (4, "")], [(1, "садовая улица"), (5, "и я"), (6, " ".join(filler[3:90]))]):
        got = matching.tolerant_positions(spark.createDataFrame(texts, "id long, norm string"), spark.createDataFrame(names, "form_id long, form string"))
        want = []
        for i, text in texts:
            words = text.split(" ")
            for f, name in names:
                form = name.split(" ")
                want += [(i, f, p, len(form)) for p in range(len(words) - len(form) + 1) if name and all(map(match, words[p : p + len(form)], form))]
        assert want and sorted((r.id, r.form_id, r.pos, r.size) for r in got.collect()) == sorted(want)
        tests = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line and "forall" in line]
        assert tests and not any(re.search(r"(?<!_)words#", line) for line in tests)
