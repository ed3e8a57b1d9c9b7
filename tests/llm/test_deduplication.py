"""Near copies, repeated passages and near vectors against brute force."""

import hashlib
import random

import numpy as np
import pytest

from geoquarry.llm.embedding_dedup import near_vectors
from geoquarry.llm.fm_index import FMIndex
from geoquarry.llm.ngram_join import Likeness, jaccard_components, one_of_each
from geoquarry.llm.substring_dedup import kept_digests, repeats, without_repeats

LONG = "wide " * 60_000


def vocabulary(count, seed=3):
    pick = random.Random(seed)
    return ["".join(pick.choices("abcdefgh", k=pick.randint(2, 7))) for _ in range(count)]


def copies(seed=5):
    """Documents in groups of near copies, with hot copies, repeated rows, nulls, empty and long texts."""
    pick, words = random.Random(seed), vocabulary(900)
    rows = []
    for group in range(30):
        base = pick.choices(words, k=pick.randint(1, 160))
        for _ in range(pick.randint(1, 6)):
            own = [pick.choice(words) if pick.random() < 0.02 else word for word in base]
            rows.append(" ".join(own))
    hot = pick.choices(words, k=90)
    for _ in range(60):
        own = list(hot)
        own[pick.randrange(90)] = pick.choice(words)
        rows.append("  ".join(own))
    shared = " ".join(pick.choices(words, k=12))
    rows += [shared + " " + " ".join(pick.choices(words, k=8)) for _ in range(25)]
    rows += ["Same Text here NOW", "same text here now", "", "", None, None, " \n\t", "one", "one", "two words", LONG, LONG + "end"]
    pick.shuffle(rows)
    ids = [10 * number for number in range(len(rows))]
    made = list(zip(ids, rows, strict=True))
    made += [made[0], (None, rows[0]), (None, None), (None, "never seen before this")]
    return made


def frame(spark, rows, extra=False):
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    if not extra:
        return made
    from pyspark.sql import functions as F

    return made.select(
        "*", F.lit("x").alias("v"), F.lit(1).alias("n"), F.lit(2).alias("component_id"), F.lit(3).alias("_row"), F.lit(4).alias("N_REMOVED"),
        F.lit(5).alias("digest"), F.lit(6).alias("_spans2"),
    )


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        words = lowered(text).encode().split()
        own = {tuple(words[at : at + width]) for at in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}
        sets.append(own)
    root = list(range(len(rows)))

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for at, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(at)] = min(least.get(find(at), id_), id_)
    return sorted(
        ((id_, len(sets[at]), least.get(find(at)) if sets[at] else id_) for at, (id_, _) in enumerate(rows)), key=str
    )


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    rows = copies()
    got = jaccard_components(frame(spark, rows, extra=True), Likeness(width, percent)).collect()
    assert sorted((tuple(row) for row in got), key=str) == brute_components(rows, width, percent)


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (3, "A b c d e f g"), (9, "other words stand here now ok"), (7, ""), (7, ""), (8, None)]
    docs = frame(spark, rows, extra=True)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((row["doc_id"], row["text"]) for row in kept.collect()) == [
        (3, "A b c d e f g"), (7, ""), (7, ""), (8, None), (9, "other words stand here now ok"),
    ] or sorted(((row["doc_id"], row["text"] or "") for row in kept.collect())) == [
        (3, "A b c d e f g"), (7, ""), (7, ""), (8, ""), (9, "other words stand here now ok"),
    ]


def test_near_copies_with_equal_or_null_ids_leave_one(spark):
    text = "one two three four five six seven eight nine ten " * 4
    copies = [text + f"and {number}" for number in range(6)]
    rows = [(4, copies[0]), (4, copies[1]), (4, copies[1]), (None, copies[2]), (None, None), (None, "")]
    nameless = [(None, text.upper().replace("ONE", "UNO").lower() + f" end {number}") for number in range(3)]
    kept = one_of_each(frame(spark, rows + nameless + nameless, extra=True)).collect()
    assert sorted((str(row["doc_id"]), bool(row["text"])) for row in kept) == [("4", True), ("None", False), ("None", False), ("None", True)]
    assert one_of_each(frame(spark, [(None, copies[0])] * 50 + [(2, copies[3])], extra=True)).collect()[0]["doc_id"] == 2


def passages(seed=11):
    pick, words = random.Random(seed), vocabulary(400, 9)
    stock = [pick.choices(words, k=pick.choice([30, 49, 50, 51, 70, 130])) for _ in range(8)]
    rows = []
    for _ in range(60):
        text = []
        for _ in range(pick.randint(0, 4)):
            text += pick.choices(words, k=pick.randint(0, 40))
            text += pick.choice(stock)
        rows.append(pick.choice([" ", "\n", " \t "]).join(text))
    rows += [" ".join(stock[5])] * 5 + ["", None, LONG, LONG, "same " * 200, "same " * 120]
    pick.shuffle(rows)
    made = [(3 * number, text) for number, text in enumerate(rows)]
    return [*made, made[4], made[4], (None, rows[0]), (None, rows[7])]


def brute_repeats(rows, window):
    seen = {}
    for id_, text in rows:
        words = (text or "").encode().split()
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            if id_ is not None:
                seen[key] = min(seen.get(key, id_), id_)
    out = []
    for id_, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if id_ is not None and seen[tuple(words[at : at + window])] < id_:
                gone[at : at + window] = [True] * window
        kept = [word for word, cut in zip(words, gone, strict=True) if not cut]
        out.append((id_, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 20])
def test_cut_passages_equal_brute_force(spark, window):
    rows = [(id_, text[:30_000] if text else text) for id_, text in passages()]
    got = kept_digests(frame(spark, rows, extra=True), window=window).collect()
    assert sorted((tuple(row) for row in got), key=str) == brute_repeats(rows, window)


def test_cut_texts_keep_all_columns(spark):
    words = " ".join(f"w{number}" for number in range(60))
    docs = spark.createDataFrame(
        [(1, words, len(words), "a"), (2, "Start " + words + "\nend", 9, "b"), (3, "left\n as it is", 14, None), (4, None, 0, "c")],
        "doc_id bigint, text string, n_chars bigint, _kept string",
    )
    cut = without_repeats(docs)
    assert cut.columns == docs.columns
    assert {row["doc_id"]: (row["text"], row["n_chars"], row["_kept"]) for row in cut.collect()} == {
        1: (words, len(words), "a"), 2: ("Start end", 9, "b"), 3: ("left\n as it is", 14, None), 4: (None, 0, "c"),
    }


def test_short_windows_are_refused(spark):
    with pytest.raises(ValueError, match="at least"):
        repeats(frame(spark, [(1, "a")]), window=3)


def test_index_finds_all_windows():
    pick = np.random.default_rng(1)
    sequences = [pick.integers(1, 4, pick.integers(0, 40)) for _ in range(40)]
    bounds = np.concatenate([[0], np.cumsum([len(own) for own in sequences])])
    for window in (2, 5, 7, 16):
        index = FMIndex(np.concatenate(sequences), bounds, window)
        names = {}
        sequence, start, block = index.window_blocks(window)
        assert len(sequence) == sum(max(len(own) - window + 1, 0) for own in sequences)
        for a, b, c in zip(sequence, start, block, strict=True):
            names.setdefault(tuple(sequences[a][b : b + window]), set()).add(int(c))
        assert all(len(found) == 1 for found in names.values())
        assert len(set().union(*names.values())) == len(names)


def vectors():
    pick = np.random.default_rng(4)
    rows, centres = [], pick.normal(size=(12, 16))
    for number in range(260):
        rows.append((centres[number % 12] + pick.normal(scale=pick.choice([0.01, 0.15, 0.6]), size=16)).tolist())
    rows += [rows[0]] * 30 + [[0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, None, [None] + [1.0] * 15]
    rows += [[1e300] * 16, [2e300] * 16, [1e-300] * 16, [1.0, 2.0], [2.0, 4.0], [3.0], []]
    made = [(7 * number % 1000, own) for number, own in enumerate(rows)]
    return [*made, made[3], (None, rows[5])]


def test_near_vectors_equal_brute_force(spark):
    rows = vectors()
    got = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    units = []
    for _, own in rows:
        good = own and all(x is not None and np.isfinite(x) for x in own) and any(own)
        scaled = np.array(own) / max(abs(x) for x in own) if good else None
        units.append(scaled / np.linalg.norm(scaled) if good else None)
    root = list(range(len(rows)))

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    links = [0] * len(rows)
    for a, left in enumerate(units):
        for b, right in enumerate(units):
            if a != b and left is not None and right is not None and len(left) == len(right) and left @ right >= 0.95:
                links[a] += 1
                root[find(a)] = find(b)
    least = {}
    for at, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(at)] = min(least.get(find(at), id_), id_)
    want = [(id_, links[at], least.get(find(at)), id_ is not None and least.get(find(at)) == id_) for at, (id_, _) in enumerate(rows)]
    assert sorted((tuple(row) for row in got), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert jaccard_components(docs).collect() == []
    assert one_of_each(docs).collect() == []
    assert kept_digests(docs).collect() == []
    assert without_repeats(docs).collect() == []
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_rounds_of_few_edges_take_few_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from geoquarry.llm import components as linked

    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(50, 53).select(F.col("id").alias("a"), F.lit(60).alias("b")))
    want = {**dict.fromkeys(range(41), 0), **dict.fromkeys([50, 51, 52, 60], 50)}
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows, parts in ((50_000, 5), (5, 8)):
            monkeypatch.setattr(linked, "TASK_ROWS", rows, raising=False)
            got = linked.components(chain.repartition(4))
            assert {row["v"]: row["component"] for row in got.collect()} == want
            assert got.rdd.getNumPartitions() <= parts
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_few_texts_that_share_bands_take_few_tasks(spark, monkeypatch):
    from geoquarry.llm import components as linked
    from geoquarry.llm.fingerprints import near_duplicates

    docs = spark.createDataFrame([(number, text) for number, text in enumerate(copies()[:60])], "doc_id bigint, text string").repartition(4)
    context = spark.sparkContext
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {name: spark.conf.get(name) for name in settings}
    found, tasks = [], []
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        for rows in (50_000, -1):
            monkeypatch.setattr(linked, "TASK_ROWS", rows, raising=False)
            context.setJobGroup(f"near copies {rows}", "")
            found.append(sorted(tuple(row) for row in near_duplicates(docs).collect()))
            tracker = context.statusTracker()
            stages = {stage for job in tracker.getJobIdsForGroup(f"near copies {rows}") for stage in tracker.getJobInfo(job).stageIds}
            tasks.append(sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in old.items():
            spark.conf.set(name, value)
    assert found[0] == found[1]
    assert 2 * tasks[0] < tasks[1]
