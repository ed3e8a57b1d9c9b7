"""Secret scans, whitening and the prefix trie against brute force, on odd input too."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquarry.llm import automata, prefix_trie, secret_scan, whitening
from geoquarry.llm.node_table import NodeTable, distinct_pairs, gather_up
from geoquarry.llm.queries import QUERIES
from test_selection import same_rows

# ---------------------------------------------------------------- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(secret_scan.KINDS[kind], start, end) for start, kind, end in sorted(spans)]


def some_texts():
    dice = random.Random(4)
    words = ["évêque", "administration", "über", "naïve—", "responsibility", "of", "the", "Straße", "conversation.", "IMPORTANT", "Overview", *("".join(dice.choices("etaoinshr", k=9)) for _ in range(300)), "ſecret=abcdefghij", "toKen=abcdefghij"]
    pieces = ["token=secret: abcdefghijkl", "PASSWORD : 'abc'", "api-key=zzzzzzzzzz", "apikey==tok", "Token=token=token=xyzxyzxy", "AKIAAKIA", "passwd\t=\tq1w2e3r4t5"]
    texts = []
    for number in range(400):
        parts = [dice.choice(words) for _ in range(dice.randrange(30))] + dice.sample(pieces, dice.randrange(3))
        if number % 3 == 0:
            parts.append(f'token = "{dice.getrandbits(160):040x}"')
        if number % 5 == 0:
            parts.append("AKIA" + "".join(dice.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)))
        if number % 4 == 0:
            parts.append(f"password={dice.getrandbits(72):018x}")
        if number % 2 == 0:
            parts.append("".join(dice.choices("0123456789", k=16)))
        dice.shuffle(parts)
        texts.append(dice.choice([" ", "\n"]).join(parts))
    return texts


def found_spans(docs, formats):
    return {row["doc_id"]: [tuple(span) for span in row["secrets"]] for row in secret_scan.secret_spans(docs, formats).collect()}


def test_secrets_of_patterns_and_formats(spark):
    texts = some_texts()
    bare = "7f3a9c01be5577d2e4"
    texts += [f"a naked {bare} in the conversation", None, "", "é" * 5 + " token=" + "A1b2" * 200_000, "." * 5000, "responsibility administration"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("secrets", F.lit("clash")).withColumn("hash", F.lit(1))
    formats = secret_scan.learn_formats(docs)
    got = found_spans(docs.repartition(3), formats)
    base = {at: [span for span in spans if span[0] in secret_scan.KINDS] for at, spans in got.items()}
    assert base == {at: plain_spans(text) for at, text in enumerate(texts)}
    added = {at: [span for span in spans if span[0] not in secret_scan.KINDS] for at, spans in got.items()}
    assert [(text_[1], text_[2]) for text_ in added[400]] == [(8, 8 + len(bare))]
    # Card numbers and words are explained by ordinary tokens.
    others = [texts[at][start:end] for at, spans in added.items() if at != 400 for _, start, end in spans if not texts[at][start:].startswith(("abcdef", "AKIA"))]
    assert len(others) <= 4, others
    for spans in got.values():
        assert spans == sorted(spans, key=lambda span: span[1])


def test_secrets_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    formats = secret_scan.learn_formats(empty)
    assert secret_scan.secret_spans(empty, formats).collect() == []
    rows = spark.createDataFrame([(None, "token=abcdefgh1"), (3, "token=abcdefgh1"), (3, "token=abcdefgh1"), (4, None)], "doc_id bigint, text string")
    got = secret_scan.secret_spans(rows, formats).collect()
    assert sorted((str(row["doc_id"]), [tuple(span) for span in row["secrets"]]) for row in got) == [
        ("3", [("assign", 0, 15)]), ("3", [("assign", 0, 15)]), ("4", []), ("None", [("assign", 0, 15)])
    ]
    # What is learned does not depend on how rows are dealt.
    docs = spark.createDataFrame([(text,) for text in some_texts()], "text string")
    one, other = (secret_scan.learn_formats(docs.repartition(parts)) for parts in (1, 5))
    assert one.counts == other.counts
    assert all((one.automata[kind].logs == other.automata[kind].logs).all() for kind in one.automata)


def test_every_example_counts_whole(spark):
    dice = random.Random(9)
    secrets = ["".join(dice.choices("abcdefghij", k=12)) for _ in range(4_500)] + ["k" * 300]
    docs = spark.createDataFrame([(at, f"token={secret}") for at, secret in enumerate(secrets)], "doc_id bigint, text string")
    one, other = (secret_scan.learn_formats(docs.repartition(parts)) for parts in (2, 7))
    assert one.counts == other.counts == {"assign": float(len(set(secrets)))}
    long = np.frombuffer(secrets[-1].encode(), np.uint8)
    for formats in (one, other):
        model = formats.automata["assign"]
        assert model.scores(long, np.array([0]), np.array([300]))[0] > automata.IMPOSSIBLE / 2
        assert model.steps[0, automata.CODES[ord("k")]] != len(model.steps) - 1
    assert (one.automata["assign"].logs == other.automata["assign"].logs).all()


def test_query_of_secrets_agrees_with_brute_force(spark, sf_dir):
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_secret_scan"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = plain_spans(texts[row["doc_id"]])
        joined = ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(span[0] == kind for span in spans) for kind in secret_scan.KINDS]
        assert set(joined.split(",")) - {""} <= set(row["spans"].split(","))


def test_automata_are_distributions_and_scores_are_sums(monkeypatch):
    dice = random.Random(8)
    words = sorted({f"AKIA{dice.getrandbits(40):010X}".encode() for _ in range(300)} | {b"x" * n for n in range(8, 20)})
    model = automata.Automaton.inferred(words)
    assert np.allclose(np.exp(model.logs).sum(axis=1) + np.exp(model.ends), 1)
    assert model.steps.shape[0] < 60 < 300
    tried = [*words[:20], b"AKIA", b"", b"AKIA-0", b"z" * 700, b"x" * 600]
    data = np.frombuffer(b"".join(tried), np.uint8)
    ends = np.cumsum([len(word) for word in tried])
    starts = ends - [len(word) for word in tried]

    def by_loops(word):
        state, total = 0, 0.0
        for letter in word:
            symbol = automata.ALPHABET.index(letter)
            total, state = total + model.logs[state, symbol], model.steps[state, symbol]
        return total + model.ends[state]

    want = [by_loops(word) for word in tried]
    assert np.allclose(model.scores(data, starts, ends), want)
    monkeypatch.setattr(automata, "SIDE_BY_SIDE", 3)
    assert np.allclose(model.scores(data, starts, ends), want)
    again = automata.Automaton.unpacked(model.packed())
    assert (again.logs == model.logs).all()


def test_states_of_different_statistics_stay_apart():
    words = [b"AA" + bytes([65 + at % 26]) * 2 + b"0" * (at % 7) for at in range(800)]
    model = automata.Automaton.inferred(sorted(set(words)))
    first = automata.CODES[ord("A")]
    assert model.steps[0, first] != 0  # after an A other letters follow than at the begin
    assert model.steps[0, automata.CODES[ord("z")]] == len(model.ends) - 1


# ---------------------------------------------------------------- whitening


def brute_whitening(vectors, width):
    kept = [(id_, [int(np.floor(256 * float(c))) for c in vector]) for id_, vector in vectors
            if vector is not None and len(vector) == width and all(c is not None and np.isfinite(c) for c in vector)]
    fit = [list(x) for x in sorted({tuple(x) for _, x in kept})]
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(width)]
    centred = np.array([[n * x[j] - sums[j] for j in range(width)] for x in fit], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1], axes[:, ::-1]


def compare(rows, vectors, width, tolerance=1e-9):
    kept, n, sums, values, axes = brute_whitening(vectors, width)
    assert len(rows) == len(kept) * min(4, width)
    by_component = defaultdict(list)
    for row in rows:
        by_component[row["component"]].append(row)
    key = lambda id_: (id_ is None, id_ or 0)
    for component, own in by_component.items():
        own.sort(key=lambda row: (key(row["vec_id"]), row["deviation"]))
        want = []
        for id_, x in kept:
            far = sum((n * x[j] - sums[j]) ** 2 for j in range(width))
            place = sum((x[j] - sums[j] / n) * axes[j, component - 1] for j in range(width))
            want.append((id_, far, place / values[component - 1] ** 0.5 if values[component - 1] > 1e-9 else None))
        want.sort(key=lambda item: (key(item[0]), item[1]))
        assert [(row["vec_id"], row["deviation"], row["n"]) for row in own] == [(id_, far, n) for id_, far, _ in want]
        if want[0][2] is None:
            assert all(row["whitened"] is None and row["explained"] < 1e-12 for row in own)
            continue
        found, wanted = np.array([row["whitened"] for row in own]), np.array([item[2] for item in want])
        assert min(abs(found - wanted).max(), abs(found + wanted).max()) < tolerance
        assert abs(own[0]["explained"] - values[component - 1] / values.sum()) < 1e-9


def test_whitening_of_odd_vectors(spark):
    dice = np.random.default_rng(3)
    vectors = [(at, [float(v) for v in dice.normal(0, [3, 1, 0.2, 0.1, 0.05])]) for at in range(300)]
    vectors += [(1000 + at, vectors[7][1]) for at in range(150)]  # copies count once in the fit
    vectors += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 5), (2004, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (2005, [1.0] * 7), (None, [0.5, -0.0, -1e-9, 0.0, 0.0]), (5, vectors[5][1])]
    rows = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("component", F.lit(1))
    got = whitening.whitened(rows.repartition(4)).collect()
    compare(got, vectors, 5)
    assert all(row["identity_error"] < 1e-8 for row in got)


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e9])
def test_whitening_of_wide_and_narrow_ranges(spark, scale, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    dice = np.random.default_rng(5)
    vectors = [(at, [float(v) * scale for v in dice.normal(0, [2, 1, 0.5])] + [7.0]) for at in range(200)]
    got = whitening.whitened(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")).collect()
    kept, n, sums, values, _ = brute_whitening(vectors, 4)
    assert {row["n"] for row in got} == {n}
    if scale == 1e9:
        exact = {id_: sum((n * x[j] - sums[j]) ** 2 for j in range(4)) for id_, x in kept}
        assert all(row["deviation"] == (exact[row["vec_id"]] if exact[row["vec_id"]] < 2**63 else None) for row in got)
    else:
        assert all(row["deviation"] is not None for row in got)
    if scale == 1.0:
        compare(got, vectors, 4)
    assert all(row["whitened"] is None for row in got if row["component"] == 4)


def test_whitening_without_vectors_or_spread(spark):
    fields = "vec_id bigint, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], fields)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], fields)).collect() == []
    rows = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], fields)).collect()
    assert [(row["n"], row["deviation"], row["whitened"], row["identity_error"]) for row in rows] == [(1, 0, None, None)] * 4


def test_planes_give_exact_products():
    dice = np.random.default_rng(9)
    block = dice.integers(-1000, 1000, (777, 6))
    lows, highs = block.min(axis=0), block.max(axis=0)
    bits = np.array([int(span).bit_length() for span in highs - lows])
    counts = whitening.plane_counts(whitening.bit_planes(block, lows, bits), int(bits.max()))
    shifted = block - lows
    for j in range(6):
        for k in range(j, 6):
            assert sum(int(count) << place for place, count in enumerate(counts[j, k])) == int((shifted[:, j] * shifted[:, k]).sum())


def test_query_of_whitening_agrees_with_brute_force(spark, sf_dir):
    vectors = [(row["vec_id"], row["embedding"]) for row in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(QUERIES["op12_whitening"](spark, sf_dir).collect(), vectors, 64, 1e-7)


# ---------------------------------------------------------------- prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    built = {}
    for conv, turns in own.items():
        taken = zlib.crc32(str(conv).encode()) % 9
        head = conv - int(np.fmod(conv, 5))
        built[conv] = tuple(turn[2:] for turn in own.get(head, [])[:taken] + turns[taken:])
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in built.items():
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(conv)
        ends[turns].append(conv)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    out = set()
    saved, leaves = defaultdict(int), defaultdict(int)
    for node in members:
        for depth in range(len(node) + 1):
            saved[node[:depth]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:depth]] += kids[node] == 0
    for node, convs in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), kids[node], leaves[node], saved[node], digest))
    return out


def some_conversations():
    dice = random.Random(12)
    rows = []
    for conv in range(-11, 90):
        if conv % 17 == 5:
            continue
        for turn in range(dice.choice([1, 2, 3, 9, 14])):
            rows.append((conv, turn, dice.choice(["user", "assistant", None]), dice.choice(["a", "é" * 9, "", None, "long text " * 5])))
    rows += [(200 + at, None if turn == 2 else turn, "user", "same for all") for at in range(60) for turn in range(6)]  # a hot first turn
    rows += [(400, turn, "user", f"{turn % 7}") for turn in range(300)] + [(401, turn, "user", f"{turn % 7}") for turn in range(200)]
    rows += [(None, 1, "user", "nobody's"), (500, None, "user", "b"), (501, 3, None, None)]
    return rows


@pytest.mark.parametrize("run", [4096, 7])
def test_trie_against_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(prefix_trie, "RUN", run)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 500)
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rows = some_conversations()
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit("clash")).withColumn("conv", F.lit(0))
    got = prefix_trie.prefix_trie(table.repartition(5)).collect()
    assert len(got) == len({(row["conv_id"], row["depth"]) for row in got})
    assert {tuple(row) for row in got} == brute_trie(rows)


def test_trie_of_repeated_rows_and_of_none(spark):
    fields = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, 1, "user", "again")] * 3 + [(5, 1, "user", "again")] * 2
    assert {tuple(row) for row in prefix_trie.prefix_trie(spark.createDataFrame(rows, fields)).collect()} == brute_trie(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], fields)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], fields)).collect() == []


def test_trie_sql(spark, sf_dir):
    same_rows(spark, "op13_prefix_trie", sf_dir, ["conversations"])


def test_slots_are_minimal_and_verified():
    dice = np.random.default_rng(2)
    for count in (0, 1, 2, 5000):
        first, second = distinct_pairs(dice.integers(0, 50, count * 2).astype(np.uint64), dice.integers(0, 1 << 20, count * 2).astype(np.uint64))
        table = NodeTable(first, second)
        slots = table.slots(first, second)
        assert sorted(slots.tolist()) == list(range(len(first))) and len(table) == len(first)
        assert (table.slots(first + np.uint64(1000), second) == -1).all()


def test_values_are_gathered_from_the_deepest_slots():
    values = np.array([1, 10, 100, 1000])
    gather_up(values, np.array([-1, 0, 1, 1]), np.array([0, 1, 2, 2]), np.add)
    assert values.tolist() == [1111, 1110, 100, 1000]
