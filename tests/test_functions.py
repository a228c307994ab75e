import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from firmlake.functions import company, dates, filing, finance, text


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_normalize_name(spark):
    got = column(spark, ["O'Brien, John-Paul (Dr.)", "", None, "Zoë  ÉCLAIR", "!!"], text.normalize_name)
    assert got == ["obrien johnpaul dr", None, None, "zoë éclair", ""]


def test_register_dates(spark):
    got = column(spark, ["15/01/2018", "not-a-date", "2018-01-15", " 1/2/2019 ", None, "31/02/2018"], dates.register_date)
    assert got == [dt.date(2018, 1, 15), None, dt.date(2018, 1, 15), dt.date(2019, 2, 1), None, None]


def test_filing_dates(spark):
    texts = ["1 April 2017", "31.12.17", "31.12.2017", "1st January 2018", "2017-04-01", "12 Dec 2016", "next year"]
    assert column(spark, texts, dates.filing_date) == [
        dt.date(2017, 4, 1), dt.date(2017, 12, 31), dt.date(2017, 12, 31), dt.date(2018, 1, 1), dt.date(2017, 4, 1),
        dt.date(2016, 12, 12), None,
    ]


def test_reference_day_and_birth(spark):
    df = spark.createDataFrame(
        [("31", "3"), ("31.0", "12"), ("x", "3"), (None, "3")], "d string, m string"
    )
    assert [r[0] for r in df.select(dates.reference_day(F.col("d"), F.col("m"))).collect()] == ["03-31", "12-31", None, None]
    born = spark.createDataFrame([("1980", "5", None), ("1980", None, "2"), ("a", "5", "1"), ("1970", "1", "31")], "y string, m string, d string")
    got = [r[0] for r in born.select(dates.partial_date(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == [dt.date(1980, 5, 1), None, None, dt.date(1970, 1, 31)]


def test_sic_codes(spark):
    df = spark.createDataFrame([("62012 - Business software", "70229 - X", None), ("None Supplied", "", "nan"), (None, None, None)], "a string, b string, c string")
    codes = company.sic_codes([F.col("a"), F.col("b"), F.col("c")])
    got = df.select(codes.alias("s"), company.primary_sic(codes).alias("p")).withColumn("i", company.industry_category("p")).collect()
    assert [list(r) for r in got] == [[["62012", "70229"], "62012", "tech"], [["None Supplied"], "None Supplied", None], [[], None, None]]


def test_quality_score(spark):
    schema = "company_number string, company_name string, company_status string, locality string, sic_codes array<string>, postal_code string, region string"
    rows = [("1", "A", "active", None, None, None, None), ("1", "A", "active", "L", ["1"], "P", "R"), ("", None, "", "", [], "", "")]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(company.quality_score()).collect()]
    assert got == [Decimal("0.70"), Decimal("1.00"), Decimal("0.00")]


def test_filing_names(spark):
    names = ["Prod223_2125_09652609_20180331.html", "Prod223_2125_SC123456_20180331.html", "Prod223_2125_09652609_20181399.html", "filing.xml", "a_12345678.html"]
    assert column(spark, names, filing.company_number_from_name) == ["09652609", "SC123456", "09652609", None, "12345678"]
    assert column(spark, names, filing.period_end_from_name) == [dt.date(2018, 3, 31), dt.date(2018, 3, 31), None, None, None]


def test_local_name_and_number(spark):
    assert column(spark, ["uk:Turnover", "{http://x:y}Turnover", "Turnover"], filing.local_name) == ["Turnover"] * 3
    got = column(spark, ["1,234", "-", "1 000.5", "1e3", "NaN", "5d"], filing.number)
    assert [None if g is None else float(g) for g in got] == [1234.0, None, 1000.5, 1000.0, None, None]


def test_display(spark):
    got = column(spark, [1_234_567.0, 0.0, None, 250_000.0, 150_000.0, -1_500_000.0, 1_234_567_890.0], finance.money_in_millions, "double")
    assert got == ["£1.2M", "N/A", "N/A", "£0.3M", "£0.1M", "£-1.5M", "£1234.6M"]
    assert column(spark, ["x", "", "NaN", None], text.display_text) == ["x", "N/A", "N/A", "N/A"]


def test_trigrams(spark):
    assert sorted(column(spark, ["Cat"], text.trigrams)[0]) == ["  c", " ca", "at ", "cat"]
    sims = column(spark, ["word", "two words", "", None], lambda c: text.trigram_similarity(c, F.lit("word")))
    assert sims[0] == 1.0 and abs(sims[1] - 4 / 11) < 1e-9
    assert sims[2] == 0.0


def test_name_facts_of_one_name_and_of_a_column_agree(spark):
    from firmlake.functions.filing import company_number_from_name, name_facts, period_end_from_name

    names = ["Prod223_2125_09652609_20180331.html", "a_b_SC123456_20181399.xml", "x_00001234_.htm", "filing-1.html", "SC123456 x.html",
             "p_q_short_00000101.xml", "_12345678.html", "", "a_b_12345678"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select("name", company_number_from_name(F.col("name")).alias("c"), period_end_from_name(F.col("name")).alias("d")).collect()
    assert {r["name"]: (r["c"], r["d"]) for r in got} == {n: name_facts(n) for n in names}


def test_more_filing_dates(spark):
    texts = ["2018-03-31T00:00:00", "2018-03-31 10:15:00Z", "2018/3/31", "31-12-17", "30 Sept 2018", "Sept. 30, 2018", "2018-03-31T25:00"]
    day = dt.date(2018, 3, 31)
    want = [day, day, day, dt.date(2017, 12, 31), dt.date(2018, 9, 30), dt.date(2018, 9, 30), day]
    assert column(spark, texts, dates.filing_date) == want
