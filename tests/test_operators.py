"""Items, flags, patterns, entities, graph and stores on small made-up tables."""

import datetime as dt
import json
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from procura.functions.similarity import can_match, match_score, token_sort_ratio
from procura.functions.text import general
from procura.operators import cluster, components, explain, graph, items, numbering, patterns, resolve, risk, scan, stats, stores, suppliers
from procura.plans import analysis, results

ITEM = "ordinal long, name string, contractor string, department string, source_file string, quantity double, unit_price double, total_price double, date date, unit string, canonical_name string"


def table(spark, rows):
    base = {"contractor": "c", "department": "d", "source_file": "f", "quantity": 1.0, "unit_price": 10.0, "unit": "шт", "date": None}
    out = []
    for i, r in enumerate(rows):
        r = base | r
        r.setdefault("total_price", (r["quantity"] or 0) * (r["unit_price"] or 0))
        out.append((i, r["name"], r["contractor"], r["department"], r["source_file"], r["quantity"], r["unit_price"], r["total_price"], r["date"], r["unit"], r["name"]))
    return spark.createDataFrame(out, ITEM)


def day(text):
    return dt.date.fromisoformat(text)


# --- items ----------------------------------------------------------------------


def test_normalise_items(spark):
    raw = spark.createDataFrame(
        [
            (1, " Цемент М400 50 кг ", "3", "10", None, None, None, "шт.", "1.2.2024"),
            (2, "a", "3", "10", "40", None, None, None, None),
            (3, "item", "1", None, None, "500", None, None, None),
            (4, "item", "4", None, None, "500", None, None, None),
            (5, "item", None, None, None, "500", "900", None, None),
            (6, "", None, None, None, None, None, None, None),
            (7, None, None, None, "7", None, None, None, None),
            (8, "item", None, "5", "20", None, None, None, None),
        ],
        "k int, name string, quantity string, unit_price string, total_price string, price string, amount string, unit string, date string",
    )
    got = {r["k"]: r for r in items.normalise_items(raw).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7, 8}
    assert (got[1]["total_price"], got[1]["canonical_name"], got[1]["date"], got[1]["unit"], got[1]["confidence"]) == (30, "цемент м400", "2024-02-01", "шт", 0.9)
    assert [w["code"] for w in got[2]["parse_warnings"]] == ["mismatch"] and got[2]["confidence"] == pytest.approx(0.8)
    assert (got[3]["unit_price"], got[3]["total_price"]) == (500, 500)
    assert (got[4]["unit_price"], got[4]["total_price"]) == (500, 2000)
    assert (got[5]["unit_price"], got[5]["total_price"], got[5]["quantity"]) == (500, 900, 1.8)
    assert [w["code"] for w in got[7]["parse_warnings"]] == ["missing"] and got[8]["quantity"] == 4
    report = items.quality_report(items.normalise_items(raw)).first()
    assert report["total"] == 7 and report["by_code"]["missing"] == 1
    assert items.quality_report(items.normalise_items(raw.limit(0))).first()["total"] == 0


def test_normalising_is_compiled_and_reads_odd_texts(spark, capsys):
    import re

    texts = ["name", "quantity", "unit", "unit_price", "total_price", "price", "amount", "contractor", "date"]
    rows = [
        ("a\u00a0\u2003b  c", "3", " Шт..\t", "10", None, None, None, "«\u3000нет ", "31.02.2024"),
        ("  Щебень 5-20\tфр. 10 кг  ", "3", None, "10", None, None, None, "  не  указан", "29.02.2024"),
        ("x, y;  2 м3", "1", None, "1", None, None, None, "\u2003нет", "29.02.2023"),
        ("  нет ", "1", None, "1", None, None, None, "A  «B»", "30/11/2023"),
    ]
    df = items.normalise_items(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in texts)))
    got = [(r["name"], r["canonical_name"], r["unit"], r["contractor"], r["date"]) for r in df.collect()]
    assert got == [
        ("a b c", "a b c", "шт", "« нет", ""), ("Щебень 5-20 фр. 10 кг", "щебень 5 20 фр", "", "", "2024-02-29"), ("x, y; 2 м3", "x y", "", "", ""), ("", "", "", "A «B»", "2023-11-30"),
    ]
    assert df._jdf.queryExecution().executedPlan().toString().count("Generate inline") == 3  # each copies rows
    capsys.readouterr()
    df.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # longer methods are not compiled by the JVM


def test_document_defaults(spark):
    from procura.sources.tables import DOCUMENT

    docs = spark.createDataFrame([("f.xlsx", None, "dep", None, None, None, {"contractor": "meta", "date": "2024-01-01"}, [("n", "1", None, None, None, None, None, None, "own", None, None, None), ("m", *[None] * 11)])], DOCUMENT)
    got = items.fill_from_document(docs).orderBy("item_pos").collect()
    assert [(r["contractor"], r["department"], r["date"]) for r in got] == [("own", "dep", "2024-01-01"), ("meta", "dep", "2024-01-01")]


def test_quarantine_and_restore(spark):
    df = table(spark, [{"name": "a", "unit_price": 0.0, "total_price": 20.0, "quantity": 4.0}, {"name": "b", "total_price": 0.0, "quantity": 2.0}, {"name": " "}, {"name": "c", "quantity": -1.0}])
    fixed, log = items.restore_totals(df)
    assert {r["name"]: (r["unit_price"], r["total_price"]) for r in fixed.collect()}["a"] == (5, 20)
    assert {(r["name"], r["field"], r["value"]) for r in log.collect()} == {("a", "unit_price", 5.0), ("b", "total_price", 20.0)}
    good, bad = items.quarantine(df)
    assert {r["name"] for r in bad.collect()} == {" ", "c"} and good.count() == 2


# --- flags ----------------------------------------------------------------------


def flags_of(spark, rows, **more):
    return risk.score_groups(table(spark, rows).withColumn("g", F.col("name")), ["g"], **more).first()


def test_flags(spark):
    one = flags_of(spark, [{"name": "прочие работы", "unit_price": 100000.0}])
    assert one["flags"] == ["single_occurrence", "vague_item", "round_number"] and one["score"] == 20 and one["risk_level"] == "MEDIUM"
    outlier = flags_of(spark, [{"name": "x", "unit_price": p, "department": f"d{i % 3}", "contractor": f"c{i}", "source_file": f"f{i}"} for i, p in enumerate((100.0, 10.0, 10.5, 11.0, 10.2, 10.1))])
    assert "iqr_strong_outlier" in outlier["flags"] and "duplicate_3_plus" in outlier["flags"] and "contractor_concentration" not in outlier["flags"]
    legacy = flags_of(spark, [{"name": "x", "unit_price": 10.0, "source_file": "a"}, {"name": "x", "unit_price": 40.0, "source_file": "b"}])
    assert "price_deviation_50" in legacy["flags"] and "contractor_concentration" in legacy["flags"]
    dated = flags_of(spark, [{"name": "x", "date": day(d), "unit": u} for d, u in (("2024-01-01", "шт"), ("2024-02-01", "кг"), ("2024-02-04", "шт"))])
    assert {"temporal_clustering", "unit_mismatch", "split_suspected"} <= set(dated["flags"])
    broken = flags_of(spark, [{"name": "x", "quantity": 3.0, "unit_price": 10.0, "total_price": 40.0}, {"name": "x", "quantity": 3.2, "unit_price": 10.0, "total_price": 32.0}])
    assert "total_mismatch" in broken["flags"] and not {"quantity_deviation_20", "quantity_deviation_50"} & set(broken["flags"])
    assert "volume_without_price" in flags_of(spark, [{"name": "x", "unit_price": None, "total_price": None}])["flags"]
    assert "price_without_volume" in flags_of(spark, [{"name": "x", "quantity": None, "total_price": None}])["flags"]
    assert "zero_quantity" in flags_of(spark, [{"name": "x", "quantity": 0.0, "total_price": None}])["flags"]
    listed = flags_of(spark, [{"name": "x"}], blacklist=spark.createDataFrame([("c",)], "contractor string"), centrality=spark.createDataFrame([("x", 0.4)], "name string, centrality double"))
    assert {"contractor_blacklist", "graph_central"} <= set(listed["flags"])


def test_groups_of_one_item_are_read_off_it(spark, monkeypatch):
    """Their items are neither sorted nor counted, and every fact is the one that counting gives."""
    rng = random.Random(5)
    pick = rng.choice
    rows = [
        {"name": f"n{rng.randrange(60)}", "unit_price": pick([None, 0.0, -2.0, 10.0, 100000.0]), "quantity": pick([None, 0.0, -1.0, 3.0]), "total_price": pick([None, 0.0, 20.0, -5.0, 200000.0]),
         "department": pick([None, "", "d"]), "contractor": pick([None, "", "c", "e"]), "unit": pick([None, "", "u"]), "source_file": pick([None, "", "f", "g"]), "date": pick([None, day("2024-01-01"), day("2024-01-03")])}
        for _ in range(90)
    ]
    items, seen, facts = table(spark, rows).withColumn("g", F.nullif("name", F.lit("n1"))), [], risk._facts

    def watched(items, keys, base):
        seen.append(items.count())
        return facts(items, keys, base)

    monkeypatch.setattr(risk, "_facts", watched)
    for keys in (["g"], ["g", "contractor"], ["g", "source_file"]):
        got = risk.score_groups(items, keys)
        want_items = items.groupBy(*keys).count().where("count > 1").agg(F.sum("count")).first()[0]
        told_apart = sorted(map(str, got.collect()))
        assert seen.pop() == want_items < 90
        with monkeypatch.context() as only:
            only.setattr(risk, "SINGLES", 0)
            assert sorted(map(str, risk.score_groups(items, keys).select(*got.columns).collect())) == told_apart
        assert seen.pop() == 90


def test_median_quantity_is_imputed(spark):
    rows = [{"name": "x", "unit_price": None, "quantity": None, "total_price": 100.0}, {"name": "x", "quantity": 4.0}, {"name": "x", "quantity": 6.0}]
    assert flags_of(spark, rows)["price"] == 20


def test_score_caps_and_levels(spark):
    names = F.array(*[F.lit(x) for x in ("iqr_strong_outlier", "contractor_blacklist", "price_deviation_100", "duplicate_3_plus", "?")])
    row = spark.range(1).select(risk.score(names).alias("s"), *[risk.risk_level(F.lit(x)).alias(f"l{x}") for x in (70, 69, 40, 20, 19)]).first()
    assert tuple(row) == (100, "CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW")


def test_explanations(spark):
    rows = [{"name": "x", "quantity": 3.0, "total_price": 40.0, "department": f"d{i}"} for i in range(2)] + [{"name": "calm", "department": "d", "source_file": s} for s in "ab"]
    df = table(spark, rows).withColumn("g", F.col("name"))
    got = {r["name"]: r for r in explain.explain(risk.score_groups(df, ["g"])).collect()}
    assert got["x"]["explanation"].startswith("Расхождение: 10 руб. (33.3%) | Закупается в 2 подразделениях")
    assert [e["flag"] for e in got["x"]["flags_explained"]][:2] == ["total_mismatch", "duplicate_2"]
    assert got["calm"]["explanation"] == "Единственный поставщик для всей группы документов"


# --- patterns and suppliers -------------------------------------------------------


def test_split_purchases(spark):
    rows = [{"name": "x", "total_price": 90000.0, "date": day(d)} for d in ("2024-01-01", "2024-01-31", "2024-03-02")]
    got = patterns.split_purchases(table(spark, rows)).collect()
    assert [(r["severity"], r["item_count"], r["threshold"]) for r in got] == [("high", 3, 100000.0)] or got[0]["item_count"] == 2
    undated = patterns.split_purchases(table(spark, [{"name": "x", "total_price": 90000.0}] * 2)).collect()
    assert [(r["severity"], r["item_count"]) for r in undated] == [("medium", 2)]


def test_other_patterns(spark):
    rows = [{"name": "x", "date": day(d), "total_price": 20000.0} for d in ("2024-01-01", "2024-01-01", "2024-01-08")] + [{"name": "y", "total_price": 20000.0}]
    df = table(spark, rows)
    hasty = patterns.suspicious_intervals(df).collect()
    assert [(r["name"], r["pair_count"], r["least_days"]) for r in hasty] == [("x", 1, 7)]
    assert [(r["item_count"], r["name_count"]) for r in patterns.repeated_amounts(df).collect()] == [(4, 2)]
    assert patterns.round_totals(df).first()["share_pct"] == 100
    summary = patterns.pattern_summary(patterns.all_patterns(df)).first()
    assert (summary["pattern_count"], summary["medium"], summary["low"]) == (3, 1, 2)
    assert patterns.all_patterns(df.limit(0)).count() == 0 and patterns.finding_items(df.limit(0)).count() == 0
    found = [(r["pattern"], r["name"], r["amount"]) for r in patterns.finding_items(df).collect()]
    assert sorted(found, key=str) == [("repeated_amounts", None, 20000.0)] * 4 + [("round_number_cluster", None, None)] * 4 + [("suspicious_intervals", "x", None)] * 2
    near = table(spark, [{"name": "x", "total_price": 90000.0, "date": day(d)} for d in ("2024-01-01", "2024-01-02", "2024-06-01")] + [{"name": "y", "total_price": 90000.0}] * 2)
    split = [(r["name"], r["severity"]) for r in patterns.finding_items(near).where("pattern = 'split_procurement'").collect()]
    assert sorted(split) == [("x", "high")] * 2 + [("y", "medium")] * 2


def test_suppliers(spark):
    df = table(spark, [{"name": "x", "contractor": c, "unit_price": p} for c, p in (("a", 60.0), ("b", 30.0), ("c", 10.0))])
    row = suppliers.concentration(df).first()
    assert row["hhi"] == pytest.approx(4600) and row["has_supplier_risk"] and row["level"] == "high"
    assert suppliers.supplier_changes(df, ["name"]).first()["suppliers"] == ["a", "b", "c"]


# --- names ------------------------------------------------------------------------


def test_contractors_resolve(spark):
    names = ["ООО «Ромашка»", "ООО Ромашка", "РОМАШКА ООО", "Ромашка", "СтройИнвест Монтаж Север", "Север СтройИнвест Монтаж", "Другой", None, "н/д"]
    df = table(spark, [{"name": "x", "contractor": n} for n in names])
    entities, aliases = resolve.resolve_contractors(df)
    ids = {r["raw"]: r["entity_id"] for r in aliases.collect()}
    assert len({ids[n] for n in names[:4]}) == 1 and ids[names[4]] == ids[names[5]] and len(set(ids.values())) == 3
    out = resolve.apply_resolution(df, aliases).orderBy("ordinal").collect()
    assert out[8]["contractor"] == "Не указан" and out[8]["contractor_id"] == "__unknown__"
    stats = resolve.registry_stats(aliases).first()
    assert (stats["total_raw"], stats["total_canonical"]) == (7, 3)
    with_inn = df.withColumn("inn", F.when(F.col("contractor").isin("Другой", "Ромашка"), "77"))
    assert resolve.resolve_contractors(with_inn)[0].count() == 2


def groups_of(aliases, name="raw"):
    out = {}
    for r in aliases.collect():
        out.setdefault(r["entity_id"], set()).add(r[name])
    return out


SPELLED = [
    ("Зета", "31"), ("ООО Зета Сервис", None), ("ООО «Ромашка»", None), ("СтройИнвест Монтаж Север", None), ("Альфа", "77"), ("Бета Плюс", None), ("н/д", None), ("ООО Ромашка", None),
    ("Север СтройИнвест Монтаж", None), ("Гамма Сервис", "77"), ("РОМАШКА ООО", "55"), ("Дельта", None), ("Бета-Плюс", None), ("Новая Дельта", "90"), ("Дельта", "90"), ("Эпсилон", "55"), ("Зета Сервис", "31"),
]


def mentions(spark, rows):
    """Items of contractors with tax numbers, in order."""
    return spark.createDataFrame([(n, "x", c, i) for n, (c, i) in enumerate(rows)], "ordinal long, name string, contractor string, inn string")


@pytest.mark.parametrize("cuts", [(3, 9), (1, 13)])
def test_a_registry_in_batches_is_that_of_one_run(spark, cuts):
    rows = SPELLED
    whole = mentions(spark, rows)
    want = groups_of(resolve.resolve_contractors(whole)[1])
    stored, before, merged = None, {}, {}
    for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        stored = resolve.register(stored, mentions(spark, rows[a:b]))
        merged |= {r["secondary_id"]: r["primary_id"] for r in stored.merges.collect()}
        ids = {raw: i for i, raws in groups_of(stored.spellings).items() for raw in raws}
        for raw, i in before.items():  # an id stays, unless its entity was taken in
            assert ids[raw] == i or merged[i] == ids[raw]
        before = ids
    assert {frozenset(g) for g in groups_of(stored.spellings).values()} == {frozenset(g) for g in want.values()}
    entities = stored.entities.collect()
    assert len({r["entity_id"] for r in entities}) == len(entities) == len(want)
    assert sum(r["mention_count"] for r in entities) == len(rows) - 1  # one is junk
    assert merged and all(r["inn"] for r in entities if r["entity_id"].startswith("inn:"))
    again = resolve.register(stored, whole.limit(0))
    assert groups_of(again.spellings) == groups_of(stored.spellings) and again.merges.count() == 0


def test_entities_merged_by_hand(spark):
    stored = resolve.register(None, mentions(spark, [("Альфа", None), ("Бета Плюс", "5"), ("Гамма", None)]))
    ids = {r["raw"]: r["entity_id"] for r in stored.spellings.collect()}
    one = resolve.merge_entities(stored, ids["Альфа"], ids["Бета Плюс"])
    assert groups_of(one.spellings) == {ids["Альфа"]: {"Альфа", "Бета Плюс"}, ids["Гамма"]: {"Гамма"}}
    row = one.entities.where(F.col("entity_id") == ids["Альфа"]).first()
    assert (row["canonical_name"], row["inn"], row["mention_count"], row["alias_count"]) == ("Бета Плюс", "5", 2, 2)
    assert resolve.merge_entities(stored, ids["Альфа"], "nobody").merges.count() == 0
    later = resolve.register(one, mentions(spark, [("ООО Бета Плюс", None)]))
    assert groups_of(later.spellings)[ids["Альфа"]] == {"Альфа", "Бета Плюс", "ООО Бета Плюс"}
    raw = {r["raw"]: r["canonical_name"] for r in resolve.known_aliases(later).collect()}
    assert raw["Альфа"] == raw["ООО Бета Плюс"]


def test_clusters_and_matching(spark):
    names = ["цемент м400", "цемент м400 мешок", "кирпич красный", "красный кирпич", "болт"]
    df = table(spark, [{"name": n, "unit_price": float(i + 1)} for i, n in enumerate(names)])
    found = {r["name"]: r["cluster_id"] for r in cluster.cluster_names(df).collect()}
    assert found["кирпич красный"] == found["красный кирпич"] and len(set(found.values())) in (3, 4) and found["цемент м400"] == 0
    groups = {r["canonical_name"]: r["group_key"] for r in cluster.match_names(df).collect()}
    assert groups["цемент м400 мешок"] == "цемент м400" and groups["красный кирпич"] == "кирпич красный"
    best = cluster.representatives(df, cluster.cluster_names(df)).collect()
    assert sum(r["cluster_size"] for r in best) == 5


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_components_of_texts_move_numbers(spark, monkeypatch):
    types, star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: types.append(dict(edges.dtypes)) or star(edges))
    links = [("doc:9", "item:b"), ("item:b", "doc:10"), ("doc:x", "item:a"), ("item:a", "item:a"), (None, "doc:9")]
    got = {(r["node"], r["component"]) for r in components.connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {("doc:10", "doc:10"), ("doc:9", "doc:10"), ("item:b", "doc:10"), ("doc:x", "doc:x"), ("item:a", "doc:x")}
    assert types and all(t == {"a": "bigint", "b": "bigint"} for t in types)


# --- graph ------------------------------------------------------------------------


def nodes_edges(spark, links):
    edges = spark.createDataFrame([(a, b, "supplies", 1.0, 1) for a, b in links], "src string, dst string, type string, weight double, item_count long")
    ids = sorted({x for e in links for x in e})
    return spark.createDataFrame([(i, i, "item", 0, "LOW", 0.0) for i in ids], "id string, label string, type string, risk_score int, risk_level string, total_price double"), edges


def brute_betweenness(links):
    from itertools import permutations

    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = dict.fromkeys(near, 0.0)

    def paths(s, t):
        front = [[s]]
        while front:
            done = [p for p in front if p[-1] == t]
            if done:
                return done
            seen = {x for p in front for x in p}
            front = [[*p, x] for p in front for x in near[p[-1]] if x not in seen]
        return []

    for s, t in permutations(near, 2):
        found = paths(s, t)
        for p in found:
            for x in p[1:-1]:
                out[x] += 1 / len(found)
    n = len(near)
    return {k: round(v / ((n - 1) * (n - 2)), 4) for k, v in out.items()}


def test_betweenness_and_paths(spark):
    links = [("a", "b"), ("b", "c")]
    vertices, edges = nodes_edges(spark, links)
    assert {r["id"]: r["centrality"] for r in graph.betweenness(vertices, edges).collect()} == {"a": 0, "b": 1, "c": 0}
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("c", "g"), ("g", "h"), ("h", "e")]
    vertices, edges = nodes_edges(spark, links)
    assert {r["id"]: r["centrality"] for r in graph.betweenness(vertices, edges).collect()} == brute_betweenness(links)
    assert [r["id"] for r in graph.shortest_path(vertices, edges, "a", "f").collect()] == ["a", "d", "e", "f"]
    apart = graph.shortest_path(*nodes_edges(spark, [("a", "b"), ("x", "y")]), "a", "y")
    assert apart.count() == 0


def test_betweenness_in_tables_is_the_same(spark, monkeypatch):
    rng = random.Random(2)
    links = list({tuple(sorted(rng.sample("abcdefghijklm", 2))) for _ in range(16)}) + [("x", "y"), ("y", "z")]
    vertices, edges = nodes_edges(spark, links)
    want = brute_betweenness(links)
    assert {r["id"]: r["centrality"] for r in graph.betweenness(vertices, edges).collect()} == want
    monkeypatch.setattr(graph, "TABLE_ROWS", len(links) * 9)  # two turns
    assert {r["id"]: r["centrality"] for r in graph.betweenness(vertices, edges, broadcast_edges=0).collect()} == want
    alone = nodes_edges(spark, [("a", "a"), ("b", "b"), ("c", "c")])
    assert {r["centrality"] for r in graph.betweenness(*alone, broadcast_edges=-1).collect()} == {0.0}


def test_betweenness_through_items_is_the_same(spark, monkeypatch):
    """Neither the tables nor the adjacency are used; copies of a contractor are one search."""
    rng = random.Random(7)
    links = {(f"item:{rng.choice('abcdefg')}", f"doc:{rng.randrange(9)}") for _ in range(16)} | {(f"item:{i}", f"contractor:{c}") for i in "ab" for c in range(5)} | {("item:x", "doc:x"), ("item:y", "doc:x")}
    vertices, edges = nodes_edges(spark, list(links))
    want = brute_betweenness(links)
    for other in ("_by_broadcast", "_by_tables"):
        monkeypatch.setattr(graph, other, None)
    assert {r["id"]: r["centrality"] for r in graph.betweenness(vertices, edges).collect()} == want
    monkeypatch.setattr(graph, "HUB_CELLS", 50)  # several turns
    monkeypatch.setattr(graph, "CHUNK_CELLS", 30)  # several chunks
    assert {r["id"]: r["centrality"] for r in graph.betweenness(vertices, edges).collect()} == want


def test_betweenness_of_sampled_sources_through_items(spark, monkeypatch):
    rng = random.Random(8)
    links = list({(f"item:{rng.randrange(6)}", f"doc:{rng.randrange(40)}") for _ in range(70)})
    vertices, edges = nodes_edges(spark, links)
    monkeypatch.setattr(graph, "SAMPLED_SOURCES", 9)
    got = {r["id"]: r["centrality"] for r in graph.betweenness(vertices, edges, exact_nodes=10).collect()}
    monkeypatch.setattr(graph, "_hubs", lambda pairs: None)
    assert got == {r["id"]: r["centrality"] for r in graph.betweenness(vertices, edges, exact_nodes=10).collect()}
    assert len({*got.values()}) > 5


def test_scans_of_a_hot_group(spark):
    """Nine tenths of all rows in one group, null the key of another: previous row and running sum as in one window."""
    rows = [(("hot" if i % 10 else None if i % 20 else f"k{i % 3}"), i * 7919 % 4001, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, o int, v long").repartition(5)
    ranged = scan.in_order(df, ["k"], ["o"])
    out = scan.with_running_sum(scan.with_previous(ranged, ["k"], ["o"], ["v"], "before"), ["k"], ["o"], F.col("v"), "run").collect()
    assert len({r["__part"] for r in out if r["k"] == "hot"}) >= 3
    by = {}
    for k, o, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        by.setdefault(k, []).append((o, v))
    want = {(k, o): (own[i - 1][1] if i else None, sum(x for _, x in own[: i + 1])) for k, own in by.items() for i, (o, _) in enumerate(own)}
    assert {(r["k"], r["o"]): (r["before"]["v"] if r["before"] else None, r["run"]) for r in out} == want


def in_sequence(names):
    """What one pass in order gives: each name's first best leader, or itself."""
    leaders, want = [], {}
    for name in names:
        best, key = 0.0, None
        for leader in leaders:
            score = match_score(name, leader) if can_match(name, leader, 90.0) else 0.0
            if score > best:
                best, key = score, leader
        if key is None or best < 90:
            leaders.append(name)
            key = name
        want[name] = key
    assert 1 < len(leaders) < len(names)
    return want


def test_matching_keeps_the_order_of_names(spark):
    """Names join the leaders that one sequential pass gives them."""
    rng = random.Random(3)
    words = ["болт", "гайка", "шайба", "кабель", "труба", "лист", "профиль", "анкер", "винт", "м6", "м8", "м10", "медный", "стальной"]
    names = list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.randint(2, 4))) + rng.choice(("", " а", "1")) for _ in range(120)))
    names += ["а", "аб", "б", "абв гд", "гд абв", "абв  гд", "x" * 300, "x" * 299 + "y", "x" * 250]
    df = table(spark, [{"name": n} for n in names]).withColumn("canonical_name", F.col("name"))
    assert {r["canonical_name"]: r["group_key"] for r in cluster.match_names(df).collect()} == in_sequence(names)
    assert cluster.match_names(df.limit(0)).count() == 0


def test_names_are_ruled_out_only_below_the_threshold():
    rng = random.Random(5)
    for _ in range(4000):
        a = "".join(rng.choice("абв г") for _ in range(rng.randint(1, 14)))
        b = "".join(rng.choice("абв г") for _ in range(rng.randint(1, 14))) if rng.random() < 0.5 else a[rng.randint(0, 3) :] + rng.choice(("", "а", " г"))
        assert can_match(a, b, 90.0) or match_score(a, b) < 90


def test_few_of_many_names_are_compared(spark):
    rng = random.Random(11)
    parts = ["".join(rng.choice("абвгдежзиклмнопрстуфхцчшэюя") for _ in range(rng.randint(4, 9))) for _ in range(900)]
    names = list(dict.fromkeys(" ".join(rng.choice(parts) for _ in range(3)) for _ in range(500)))
    names += [n[:-1] + "ъ" for n in names[:60]] + [" ".join(reversed(n.split())) for n in names[60:120]] + [n + " новый" for n in names[120:160]]
    names = list(dict.fromkeys(names))
    df = table(spark, [{"name": n} for n in names]).withColumn("canonical_name", F.col("name"))
    got = {r["canonical_name"]: r["group_key"] for r in cluster.match_names(df).collect()}
    assert got == in_sequence(names)
    met = cluster.match_candidates(df.select(F.col("ordinal").alias("id"), F.col("name").alias("text"))).count()
    assert met < len(names) * (len(names) - 1) / 2 * 0.1, met


def test_a_row_of_names_that_depend_on_each_other(spark):
    """0 - 1 - 2 - ...: every second one leads."""
    pairs = spark.createDataFrame([(i, i + 1, 95.0) for i in range(9)] + [(0, 20, 91.0), (1, 20, 99.0)], "i long, j long, score double")
    assert sorted(r["id"] for r in cluster.lead(pairs).collect()) == [1, 3, 5, 7, 9, 20]



def test_pairs_by_sorted_word_ratio_match_brute_force(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcd  ") for _ in range(rng.randint(3, 14))).strip() for _ in range(80)} | {"steel bolt", "steell bolts", "bolt steel"})
    df = spark.createDataFrame([(n,) for n in names if n], "text string")
    for least in (60.0, 85.0):
        want = {(a, b) for a in names for b in names if a and a < b and token_sort_ratio(a, b) >= least}
        assert {(r["x"], r["y"]) for r in cluster.ratio_pairs(df, least).collect()} == want and want


def plain_modularity(n, links):
    """Every merge by looking at all pairs."""
    m = len(links)
    share, parts = [Fraction(sum(i in e for e in links), 2 * m) for i in range(n)], {i: {i} for i in range(n)}
    while True:
        best = None
        for a in parts:
            for b in parts:
                between = sum((x in parts[a] and y in parts[b]) or (x in parts[b] and y in parts[a]) for x, y in links)
                if a < b and between:
                    gain = Fraction(between, m) - 2 * sum(share[i] for i in parts[a]) * sum(share[i] for i in parts[b])
                    if best is None or gain > best[0]:
                        best = (gain, a, b)
        if best is None or best[0] <= 0:
            return sorted(sorted(p) for p in parts.values())
        parts[best[1]] |= parts.pop(best[2])


def test_greedy_modularity_matches_plain_search():
    for seed in range(6):
        rng = random.Random(seed)
        links = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(24)})
        assert sorted(graph.greedy_modularity(14, links)) == plain_modularity(14, links)


def test_merges_cost_what_the_smaller_community_has(monkeypatch):
    pushed, push = [], graph.heappush
    monkeypatch.setattr(graph, "heappush", lambda heap, entry: (pushed.append(1), push(heap, entry)))
    rng, leaves = random.Random(5), 2000
    links = [(i, leaves + hub) for i in range(leaves) for hub in rng.sample(range(8), rng.randint(1, 3))]
    groups = graph.greedy_modularity(leaves + 8, links)
    assert sorted(i for g in groups for i in g) == list(range(leaves + 8)) and len(groups) <= 8
    assert len(pushed) < 20 * len(links)
    for few in (0, 2):
        monkeypatch.setattr(graph, "FEW_NEIGHBOURS", few)
        assert graph.greedy_modularity(leaves + 8, links) == groups
        small = sorted({(i, 12 + hub) for i in range(12) for hub in rng.sample(range(3), rng.randint(1, 2))})
        assert sorted(graph.greedy_modularity(15, small)) == plain_modularity(15, small)


def test_nodes_without_edges_are_communities_of_their_own(spark):
    vertices, edges = nodes_edges(spark, [("a", "b"), ("c", "d")])
    assert [r["nodes"] for r in graph.communities(vertices, edges.where("false")).collect()] == [["a"], ["b"], ["c"], ["d"]]


def many_items(spark, n=600):
    """Items of three groups on days of three years, many on one day, from a table that a plan shows as a range."""
    k = F.col("id")
    return spark.range(n).select(
        k.alias("ordinal"), F.concat(F.lit("n"), (k % 3).cast("string")).alias("name"), F.lit("c").alias("contractor"), F.lit("d").alias("department"), F.lit("f").alias("source_file"),
        F.lit(1.0).alias("quantity"), (k * 37 % 101 + 1).cast("double").alias("unit_price"), (k * 37 % 101 + 1).cast("double").alias("total_price"),
        F.date_add(F.lit(day("2022-01-01")), F.when(k % 5 == 0, 400).otherwise(k * 7 % 1000).cast("int")).alias("date"), F.lit("u").alias("unit"),
        F.concat(F.lit("n"), (k % 3).cast("string")).alias("canonical_name"),
    )


def plan(df):
    return df._jdf.queryExecution().toString()


def test_trends_put_only_months_in_order_in_which_a_third_ends(spark, monkeypatch):
    ordered, whole = [], stats.in_order
    monkeypatch.setattr(stats, "in_order", lambda df, *a: (ordered.append(df.count()), whole(df, *a))[1])
    table_ = many_items(spark)
    got = {r["name"]: r for r in stats.price_trend(table_, ["name"]).collect()}
    assert len(ordered) == 1 and ordered[0] < 300
    for name, rows in {f"n{i}": sorted((r["date"], r["ordinal"], r["unit_price"]) for r in table_.collect() if r["name"] == f"n{i}") for i in range(3)}.items():
        prices, third = [r[2] for r in rows], len(rows) // 3
        assert got[name]["avg_first"] == pytest.approx(statistics.mean(prices[:third]), abs=0.0051) and got[name]["avg_last"] == pytest.approx(statistics.mean(prices[-third:]), abs=0.0051)
        assert (got[name]["date_from"], got[name]["date_to"], got[name]["observations"]) == (rows[0][0], rows[-1][0], len(rows))


def test_price_analysis_reads_its_items_once(spark):
    assert "Range (" not in plan(stats.group_price_analysis(many_items(spark), ["name"]))


def test_patterns_read_their_items_once(spark):
    for found in (patterns.all_patterns, patterns.finding_items):
        assert "Range (" not in plan(found(many_items(spark)))


def test_first_items_of_few_groups_are_looked_up(spark):
    base = risk.group_base(many_items(spark), ["name"])
    assert "min_by" not in plan(base)
    assert {(r["name"], r["n_items"], r["first"]["unit_price"]) for r in base.collect()} == {("n0", 200, 1.0), ("n1", 200, 38.0), ("n2", 200, 75.0)}


def test_communities(spark):
    links = [(x, y) for g in ("abcd", "wxyz") for x in g for y in g if x < y] + [("d", "w")]
    got = [r["nodes"] for r in graph.communities(*nodes_edges(spark, links)).collect()]
    assert sorted(got) == [list("abcd"), list("wxyz")]


def test_graph_of_items(spark):
    df = table(spark, [{"name": "x", "contractor": "c1"}, {"name": "x", "contractor": " Не указан", "department": "Не определён"}, {"name": "y", "contractor": "c1", "department": "неизвестный отдел"}])
    vertices, edges = graph.build_graph(df)
    assert {r["id"] for r in vertices.collect()} == {"item:x", "item:y", "contractor:c1", "dept:d", "doc:f"}
    assert {(r["src"], r["dst"], r["weight"]) for r in edges.where("type = 'bought'").collect()} == {("dept:d", "item:x", 1.0)}
    kept, own = graph.filter_graph(vertices, edges, ("item", "contractor"))
    assert kept.count() == 3 and own.count() == 2 and graph.export_json(kept, own).count() == 5
    central = graph.betweenness(vertices, edges)
    told = {}
    for r in graph.export_json(vertices, edges, central, include_stats=True).collect():
        told.setdefault(r["kind"], []).append(json.loads(r["json"]))
    assert {n["id"]: n["color"] for n in told["node"]} == {"item:x": "#3dd68c", "item:y": "#3dd68c", "contractor:c1": "#009688", "dept:d": "#2196f3", "doc:f": "#795548"}
    assert {e["type"]: e["label"] for e in told["edge"]} == {"bought": "купил", "supplies": "поставляет", "contains": "содержит"}
    assert told["stats"][0]["n_nodes"] == 5 and told["dominant_supplier"][0]["contractor"] == "c1"
    assert {r["id"] for r in graph.graph_context(vertices, central).collect()} == {"item:x", "item:y"}


def test_numbers_in_a_global_order(spark):
    values = [None, *(f"s{(i * 37) % 101:03}" for i in range(101))]
    df = spark.createDataFrame([(v, "x") for v in values], "v string, n string")
    got = numbering.numbered(df, [F.col("v").asc_nulls_last()], "place").collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["place"])] == [*sorted(values[1:]), None] and [r["place"] for r in sorted(got, key=lambda r: r["place"])] == list(range(102))
    assert numbering.numbered(df.limit(0), [F.col("v")], "place").count() == 0


def test_a_long_path(spark):
    vertices, edges = nodes_edges(spark, [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)])
    assert [r["id"] for r in graph.shortest_path(vertices, edges, "n000", "n040").collect()] == [f"n{i:03}" for i in range(41)]


def one_sided_path(links, source, target):
    """The path that a search from the source alone finds, each node's parent its smallest neighbour one step nearer."""
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    depth, front = {source: 0}, [source]
    while front:
        front = sorted({y for x in front for y in near.get(x, ())} - set(depth))
        depth |= {y: max(depth.values()) + 1 for y in front}
    path = [target] if target in depth else []
    while path and path[-1] != source:
        path.append(min(x for x in near[path[-1]] if depth[x] == depth[path[-1]] - 1))
    return path[::-1]


def test_a_search_from_both_ends_finds_the_same_path(spark):
    rng = random.Random(5)
    links = [tuple(rng.sample(range(10, 40), 2)) for _ in range(38)] + [(10, 10), (50, 51)]
    links = [(f"n{a}", f"n{b}") for a, b in links]
    vertices, edges = nodes_edges(spark, links * 2)
    ends = [("n10", "n39"), ("n39", "n11"), ("n12", "n12"), ("n50", "n10"), *((f"n{rng.randrange(10, 40)}", f"n{rng.randrange(10, 40)}") for _ in range(2))]
    want = [one_sided_path(links, *pair) for pair in ends]
    assert max(map(len, want)) > 4
    for pair, path in zip(ends, want, strict=True):
        got = graph.shortest_path(vertices, edges, *pair).collect()
        assert ([r["id"] for r in got], [r["step"] for r in got]) == (path, list(range(len(path)))), pair
    assert graph.shortest_path(vertices, edges, None, "n10").count() == graph.shortest_path(vertices, edges, "n10", "away").count() == 0


def test_a_path_search_writes_little(spark, monkeypatch):
    """The source's neighbour has many neighbours, the target's side few: the many are not searched on, and no edge is written twice."""
    wide = [("s", "hub"), ("s", "o"), *(("hub", f"w{i:03}") for i in range(300)), ("hub", "m"), ("m", "l"), ("l", "k"), ("k", "t")]
    wide += [(f"w{i:03}", f"x{i:03}") for i in range(300)]
    vertices, edges = nodes_edges(spark, wide)
    written, write = {}, graph.materialise

    def noted(df, label, codec=None):
        out = write(df, label, codec)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(graph, "materialise", noted)
    assert [r["id"] for r in graph.shortest_path(vertices, edges, "s", "t").collect()] == ["s", "hub", "m", "l", "k", "t"]
    assert written.pop("path-edges") == len(wide)
    assert sum(written.values()) < 20


def test_links_are_those_of_the_network(spark):
    rows = [("bolt", "A", "d1", "f1"), ("bolt", "A", "d1", "f2"), ("nut", " A ", "Не определён", "f1"), ("nut", "-", None, None), ("lone", "", "unknown", " "), ("", "B", "d2", "f3"), (None, "B", "d2", "f3")]
    df = table(spark, [{"name": n, "contractor": c, "department": d, "source_file": f, "total_price": 1.0} for n, c, d, f in rows])
    (nodes, links), (vertices, edges) = graph.build_links(df), graph.build_graph(df)
    key = ("id", "label", "type")
    assert sorted(map(tuple, nodes.select(*key).collect())) == sorted(map(tuple, vertices.select(*key).collect()))
    assert {tuple(r) for r in links.select("src", "dst", "type").collect()} == {tuple(r) for r in edges.select("src", "dst", "type").collect()}
    assert [r["label"] for r in graph.shortest_path(nodes, links, "item:lone", "item:lone", written=True).collect()] == ["lone"]


def test_suppliers_that_are_none(spark):
    """Unnamed contractors, as the resolution of names writes them, supply nothing."""
    rows = [("x", "A"), ("x", "Не указан"), ("y", "A"), ("y", "-"), ("y", "B"), ("z", ""), ("z", "Не указан "), ("w", "A"), ("w", "B"), ("w", "C"), ("w", None)]
    df = table(spark, [{"name": n, "contractor": c} for n, c in rows])
    changes = [(r["name"], r["suppliers"], r["severity"]) for r in suppliers.supplier_changes(df, ["name"]).collect()]
    assert changes == [("w", ["A", "B", "C"], "high"), ("y", ["A", "B"], "medium")]
    shares = {r["contractor"]: r["share_pct"] for r in suppliers.supplier_shares(df).collect()}
    assert set(shares) == {"A", "B", "C"} and sum(shares.values()) == pytest.approx(100)
    assert suppliers.concentration(df).first()["n_suppliers"] == 3
    assert suppliers.department_concentration(df).first()["n_suppliers"] == 3
    assert {r["name"]: r["switches"] for r in suppliers.switches(df.withColumn("date", F.lit(day("2024-01-01"))), ["name"]).collect()} == {"x": 0, "y": 1, "w": 2}


def test_pairs_of_hasty_purchases(spark):
    rows = [("x", "2024-01-01"), ("x", "2024-01-01"), ("x", "2024-01-08"), ("x", "2024-01-16"), ("y", "2024-01-01"), ("y", "2024-01-02")]
    df = table(spark, [{"name": n, "date": day(d)} for n, d in rows])
    got = {(r["name"], r["interval_days"], str(r["date1"]), str(r["date2"])) for r in patterns.interval_pairs(df).collect()}
    assert got == {("x", 7, "2024-01-01", "2024-01-08"), ("y", 1, "2024-01-01", "2024-01-02")}


def test_numbers_to_six_digits(spark):
    values = [0.0, 5.0, 12.5, 1234.5678, 999999.6, 1e6, 1234567.0, 0.00012345678, 0.00001, 123456.0, 99999.96, -2.50, 1e10]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", general(F.col("v")).alias("g")).collect()
    assert {r["v"]: r["g"] for r in got} == {v: f"{v:g}" for v in values}


def test_facts_that_list_dates_and_quantities(spark):
    rows = [{"name": "x", "quantity": q, "date": day(f"2024-01-0{d}")} for q, d in ((3.0, 1), (1.0, 2), (1.0, 2), (2.5, 3), (7.0, 4), (8.0, 5), (9.0, 6), (10.0, 7))]
    got = explain.explain(risk.score_groups(table(spark, rows), ["name"])).first()
    facts = {f["flag"]: f["facts"] for f in got["flags_explained"]}
    assert facts["temporal_clustering"] == "Даты закупок: " + ", ".join(f"2024-01-0{d}" for d in range(1, 7)) + "…"
    assert facts["quantity_deviation_50"] == "Объёмы по документам: 1 / 1 / 2.5 / 3 / 7 / 8 шт"
    odd = risk.score_groups(table(spark, rows), ["name"]).withColumn("flags", F.array(F.lit("new_flag"), F.lit("single_occurrence")))
    told = explain.explain(odd).first()
    assert [f["flag"] for f in told["flags_explained"]] == ["single_occurrence", "new_flag"]
    assert told["flags_explained"][1]["deviation"] == "Требует ручной проверки" and told["explanation"].endswith(" | Флаг: new_flag")


def test_groups_without_a_key_are_groups(spark):
    df = table(spark, [{"name": "x"}, {"name": "x", "unit_price": 30.0}, {"name": None}, {"name": None, "unit_price": 50.0}, {"name": None}])
    got = {r["name"]: (r["n"], r["median"]) for r in stats.group_stats(df, ["name"], F.col("unit_price")).collect()}
    assert got == {"x": (2, 20), None: (3, 10)}
    assert {r["name"]: r["n_items"] for r in risk.score_groups(df, ["name"]).collect()} == {"x": 2, None: 3}


def test_order_statistics_of_a_hot_group(spark):
    """Nine tenths of the values in one group: it lies in several partitions and is counted across them."""
    values = [("hot", float((i * 7919) % 5003)) for i in range(9000)] + [(f"g{i % 50}", float(i)) for i in range(1000)]
    df = spark.createDataFrame(values, "k string, v double")
    counts = stats._counts(df, ["k"], F.col("v"))
    ranked = stats._ranked(counts, ["k"])
    assert ranked.where("k = 'hot'").agg(F.max("hi"), F.max("n")).first() == (9000, 9000)
    got = {r["k"]: (r["median"], r["q1"], r["q3"]) for r in stats.group_stats(df, ["k"], F.col("v")).collect()}
    for k in ("hot", "g7"):
        own = sorted(v for g, v in values if g == k and v > 0)
        half = len(own) // 2
        assert got[k] == (statistics.median(own), statistics.median(own[:half]), statistics.median(own[len(own) - half :]))


# --- stores -----------------------------------------------------------------------


def test_feedback(spark, tmp_path):
    rows = [(i, "x" if i < 6 else "y", v, ["f1", "f2"] if i < 6 else ["f3"]) for i, v in enumerate(["false_positive"] * 6 + ["confirmed_fraud"] * 3)]
    log = spark.createDataFrame([(i, n, v, f, 50, None, None, None, None, None, dt.datetime(2024, 1, 1), None) for i, n, v, f in rows], stores.VERDICT)
    path = str(tmp_path / "log")
    stores.save_store(log, path)
    stores.save_store(log, path)
    log = stores.load_store(spark, path, stores.VERDICT)
    assert log.count() == 9 and stores.load_store(spark, path + "x", stores.VERDICT).count() == 0
    assert [r["item_name"] for r in stores.false_positives(log).collect()] == ["x"]
    advice = {r["flag"]: r["recommendation"] for r in stores.flag_recommendations(log).collect()}
    assert advice == {"f1": "suppress", "f2": "suppress", "f3": "amplify"}
    assert [r["flag"] for r in stores.ordered_recommendations(log).collect()] == ["f1", "f2", "f3"]
    assert {r["flag"]: r["multiplier"] for r in stores.adjusted_multipliers(log).collect()} == {"f1": 0.9, "f2": 0.9, "f3": 1.1}
    assert {r["flag"]: r["multiplier"] for r in stores.adjusted_multipliers(log, True).collect()}["f1"] == pytest.approx(0.5314)
    scored = spark.createDataFrame([("x", 80), ("y", 80)], "name string, score int")
    assert {r["name"]: (r["score"], r["risk_level"]) for r in stores.suppress(scored, log).collect()} == {"x": (15, "LOW"), "y": (80, "CRITICAL")}
    assert stores.feedback_stats(log).first()["total"] == 9
    later = stores.record_verdict(log, "x", "valid", flags=["f1"])
    assert later.agg(F.max("seq")).first()[0] == 9 and stores.false_positives(later).isEmpty()
    with pytest.raises(ValueError):
        stores.record_verdict(log, "x", "maybe")
    assert [r["seq"] for r in stores.feedback_page(log, limit=2, offset=1).collect()] == [2, 1]


def test_context(spark):
    log = spark.createDataFrame([(1, "ООО Ромашка", None, "trusted", [], None, None), (2, "Ромашка", None, "blacklisted", [], None, None), (3, "Бета", "77", "neutral", [], None, None)], stores.CONTRACTOR)
    df = table(spark, [{"name": "x", "contractor": c} for c in ("ЗАО «Ромашка»", "Бета", "нет такого")])
    assert [r["contractor_status"] for r in stores.contractor_status(df, log).orderBy("ordinal").collect()] == ["blacklisted", "neutral", "unknown"]
    market = spark.createDataFrame([(1, "X", None, None, 1.0, 3.0, 2.0, None, None), (2, "x ", None, None, 1.0, 3.0, 2.5, None, None)], stores.MARKET_PRICE)
    known = stores.item_context(df, log, market, stores.price_history(df)).first()
    assert (known["market_ref_price"], known["historical_ref_price"], known["historical_n"], known["category"]) == (2.5, 10, 3, "default")
    assert tuple(stores.context_summary(log, market, stores.price_history(df)).first())[:4] == (2, 1, 1, 1)
    feedback = spark.createDataFrame(
        [(i, "x", "false_positive", ["round_number", "unknown"]) for i in range(5)] + [(9, "x", "valid", ["duplicate_2"])], "seq long, item_name string, verdict string, flags array<string>"
    )
    assert stores.context_summary(log, market, stores.price_history(df), feedback).first()["flag_adjustments"] == {"round_number": 0.9}
    assert stores.context_summary(log, market, stores.price_history(df), feedback.limit(0)).first()["flag_adjustments"] == {}
    row = spark.range(1).select(stores.category(F.lit("Ремонт кровли")).alias("c"), stores.effective_weights(F.lit("строительство"), F.lit(1.0))["duplicate_3_plus"].alias("w"), stores.effective_weights(F.lit("?"), F.lit(9.0))["duplicate_3_plus"].alias("m")).first()
    assert tuple(row) == ("строительство", 32, 100)


def test_cases(spark):
    new = lambda seq, case, kind, **f: stores.case_event(spark, seq, case, kind, at=dt.datetime(2024, 1, seq), **f)
    link = [("x", 75, "CRITICAL", None, None, None)]
    log = new(1, "a", "created", title="A", status="new", items=link).unionByName(new(2, "a", "status", status="confirmed")).unionByName(new(3, "b", "created", title="B")).unionByName(new(4, "b", "delete"))
    assert [(r["before"], r["now"]) for r in stores.invalid_steps(log).collect()] == [("new", "confirmed")]
    results = spark.createDataFrame([("x", 75, "CRITICAL", "c", "d", "f"), ("y", 30, "MEDIUM", "c", "d", "f")], "name string, score int, risk_level string, contractor string, department string, source_file string")
    made = stores.create_case(log, "n", " New ", results, ["x", "none"], author="me", initial_comment="look ")
    made = stores.update_status(stores.add_comment(made, "n", "again"), "n", "in_review", author="you", text="why")
    case = stores.get_case(made, "n").first()
    assert (case["title"], case["status"], [i["item_name"] for i in case["items"]], [c["text"] for c in case["comments"]]) == ("New", "in_review", ["x"], ["look", "again"])
    assert [(c["from_status"], c["to_status"], c["analyst"], c["note"]) for c in case["status_history"]] == [("new", "in_review", "you", "why")]
    for events, case_id, status in ((made, "n", "gone"), (log, "a", "new")):
        with pytest.raises(ValueError):
            stores.update_status(events, case_id, status)
    with pytest.raises(KeyError):
        stores.get_case(made, "b")
    cases = stores.fold_cases(log)
    assert [(r["case_id"], r["status"], r["priority"], r["max_score"]) for r in cases.collect()] == [("a", "confirmed", "critical", 75)]
    assert stores.filter_cases(cases, priority="critical", min_score=70).count() == 1 and stores.case_stats(cases).first()["open"] == 1
    scored = spark.createDataFrame([("x", "c", 75, 1.0, 1), ("y", "c", 50, 1.0, 2), ("z", "c", 45, 1.0, 3), ("w", "", 45, 1.0, 4)], "name string, contractor string, score int, total_price double, first_ordinal long")
    got = {(r["kind"], r["title_key"], r["n_items"]) for r in stores.auto_cases(scored, cases).collect()}
    assert got == {("contractor", "c", 2), ("contractor", "Без контрагента", 1)}


# --- the whole --------------------------------------------------------------------


def test_analysis(spark):
    raw = spark.createDataFrame(
        [(i, n, c, "d", f"f{i}.xlsx", str(q), str(p), f"{1 + i}.02.2024") for i, (n, c, q, p) in enumerate([("Цемент М400", "ООО «Ромашка»", 2, 100), ("цемент м400 мешок", "Ромашка", 2, 110), ("Кирпич", "Бета", 5, 9), ("Цемент М400", "Бета", 3, 500)])],
        "ordinal long, name string, contractor string, department string, source_file string, quantity string, unit_price string, date string",
    )
    out = analysis.analyse(raw, graph_documents=True)
    groups = {r["group_key"]: r for r in out.groups.collect()}
    assert set(groups) == {"цемент м400", "кирпич"} and groups["цемент м400"]["n_items"] == 3
    assert out.entities.count() == 2 and out.concentration.first()["n_suppliers"] == 2 and out.history.count() == 4
    assert results.filter_results(out.groups, contractor="ромаш").count() == 1
    assert results.find(out.groups, "Кирпич").count() == 1 and results.find(out.groups.withColumnRenamed("name", "item"), "Кирпич").count() == 1 and results.sort_table(out.groups, "name").count() == 2
    from procura.sources.report import generate_report

    assert generate_report(out.groups, ["f.xlsx"])[:2] == b"PK"


def test_communities_through_items_are_those_of_plain_merging(spark, monkeypatch):
    import numpy as np

    from procura.operators.modularity import greedy_by_hubs

    luck = random.Random(11)
    for _ in range(200):
        n = luck.randint(3, 60)
        nodes = list(range(n))
        luck.shuffle(nodes)
        hubs = sorted(nodes[: luck.randint(1, min(9, n - 1))])
        links = [(leaf, h) for leaf in nodes if leaf not in hubs for h in luck.sample(range(len(hubs)), luck.randint(0, min(len(hubs), 4)))]
        if links:
            ends, codes = np.array(links).T
            of = greedy_by_hubs(n, np.array(hubs), ends, codes).tolist()
            plain = graph.greedy_modularity(n, [(leaf, hubs[h]) for leaf, h in links])
            assert [[i for i in range(n) if of[i] == c] for c in range(len(plain))] == plain
    edges = [(f"doc:{d}", f"item:{i}") for d in range(40) for i in {d % 3, d * 7 % 5}] + [(f"item:{i}", "contractor:1") for i in range(5)]
    vertices = spark.createDataFrame([(v, v.split(":")[0]) for v in sorted({x for e in edges for x in e} | {"item:9", "doc:z"})], "id string, type string")
    table = spark.createDataFrame(edges, "src string, dst string")
    monkeypatch.setattr(graph, "MAX_COMMUNITY_HUBS", 0)
    plain = graph.communities(vertices, table).collect()
    monkeypatch.undo()
    monkeypatch.setattr(graph, "greedy_modularity", None)  # holds dictionaries of neighbours
    assert graph.communities(vertices, table).collect() == plain


def test_components_of_what_is_shared_move_it_once(spark, monkeypatch):
    luck = random.Random(3)
    pairs = [(luck.randint(0, 90), f"label {luck.randint(0, 120)}") for _ in range(110)]
    rows = spark.createDataFrame([*pairs, *pairs[:9], (None, "label 1"), (5, None)], "d long, l string")
    written = {}
    monkeypatch.setattr(components, "materialise", lambda df, label, codec=None: written.setdefault(label, df.localCheckpoint()) if label == "shared-stars" else df.localCheckpoint())
    found = sorted(r["n_nodes"] for r in components.shared_sizes(rows, "d", "l").collect())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    sizes = {}
    for x in list(parent):
        sizes[root(x)] = sizes.get(root(x), 0) + 1
    assert found == sorted(sizes.values())
    assert "string" not in dict(written["shared-stars"].dtypes).values()  # neither written nor moved again


def test_items_of_many_groups_move_with_a_number(spark, monkeypatch):
    rows = [(i, f"pump {i % 40}", f"doc {i % 7}", "d", "c", "pcs", 1.0 + i % 3, 10.0 + i % 11, 10.0, dt.date(2024, 1, 1 + i % 20)) for i in [*range(40), *range(0, 60, 2)]]
    table = spark.createDataFrame(rows, "ordinal long, name string, source_file string, department string, contractor string, unit string, quantity double, unit_price double, total_price double, date date")
    keys = ["name", "source_file"]
    order = lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(risk, "SINGLES", 0.0)
    plain = order(risk.score_groups(table, keys).select("name", "source_file", "n_items", "flags", "score", "dates", "same_source"))
    monkeypatch.setattr(risk, "SINGLES", 10)
    used = []
    stats_of = risk.group_stats
    monkeypatch.setattr(risk, "group_stats", lambda df, keys, value: used.append(keys) or stats_of(df, keys, value))
    assert order(risk.score_groups(table, keys).select("name", "source_file", "n_items", "flags", "score", "dates", "same_source")) == plain
    assert not any(set(keys) & set(k) for k in used)
