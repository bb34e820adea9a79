"""Column functions against hand-written rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lotline.functions import amounts, clock, codes, display

NIGHT = [0, 5, 6, 13, 14, 21, 22, 23]


def stamps(hours):
    return [(dt.datetime(2024, 3, 1, h, 59, 59),) for h in hours]


def test_shift_boundaries(values):
    got = values(clock.shift_of_hour(F.hour("t")), [*stamps(NIGHT), (None,)], "t timestamp_ntz")
    assert got == ["3 TURNO", "3 TURNO", "1 TURNO", "1 TURNO", "2 TURNO", "2 TURNO", "3 TURNO", "3 TURNO", None]


def test_business_date_boundaries(values):
    got = values(clock.business_date(F.col("t")), stamps(NIGHT), "t timestamp_ntz")
    before, same = dt.date(2024, 2, 29), dt.date(2024, 3, 1)
    assert got == [before, before] + [same] * 6


def test_business_window_equals_filter_on_business_date(values):
    ts = [(dt.datetime(2024, 3, d, h, m, 0),) for d in (1, 2) for h in (0, 5, 6, 7, 23) for m in (0, 59)]
    bound = clock.business_day_start("2024-03-04 01:02:03", 2)
    assert bound == dt.datetime(2024, 3, 2, 6)
    plain = F.col("t") >= clock.time_literal(bound)
    derived = clock.business_date(F.col("t")) >= F.lit(dt.date(2024, 3, 2))
    assert values(plain, ts, "t timestamp_ntz") == values(derived, ts, "t timestamp_ntz")


def test_latest_of_tolerates_one_missing_date(values):
    a, b, c = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
    rows = [(a, b, c), (None, b, a), (c, None, a), (a, b, None), (a, None, None), (None, None, c), (None, None, None)]
    got = values(
        clock.latest_of(F.col("a"), F.col("b"), F.col("c")), rows, "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz"
    )
    assert got == [c, b, c, b, None, None, None]


def test_age_counts_dates_not_hours(values):
    rows = [(dt.datetime(2024, 1, 1, 23, 59),), (dt.datetime(2024, 1, 2, 0, 0),), (None,)]
    assert values(clock.age_days("2024-01-02 00:01:00", F.col("t")), rows, "t timestamp_ntz") == [1, 0, None]


def test_as_of_forms():
    want = dt.datetime(2024, 1, 2)
    assert clock.as_moment("2024-01-02") == clock.as_moment(dt.date(2024, 1, 2)) == clock.as_moment(want) == want


def test_text_to_time_gives_null_for_other_text(values):
    rows = [("2024-01-02 03:04:05",), ("02/01/2024",), (None,)]
    assert values(clock.text_to_time(F.col("s")), rows, "s string") == [dt.datetime(2024, 1, 2, 3, 4, 5), None, None]


def test_wall_clock_is_kept_in_a_zone_that_skips_it(spark, values):
    skipped = [(dt.datetime(2018, 11, 4, 0, 30, 15, 250000),), (None,)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        t, schema = F.col("t"), "t timestamp_ntz"
        assert values(clock.to_second(t), skipped, schema) == [dt.datetime(2018, 11, 4, 0, 30, 15), None]
        assert values(clock.second_text(t), skipped, schema) == ["04/11/2018 00:30:15", None]
        assert values(clock.minute_text(t), skipped, schema) == ["04/11/2018 00:30", None]
        assert values(clock.hour_text(t), skipped, schema) == ["00", None]
        assert values(clock.business_date(t), skipped, schema) == [dt.date(2018, 11, 3), None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_truncate_and_round_away_from_zero(values):
    rows = [(Decimal(x),) for x in ("1.239", "-1.239", "2.5", "-2.5", "0.999")]
    cut = values(amounts.truncate_number(F.col("x")), rows, "x decimal(10,3)")
    assert cut == [Decimal(x) for x in ("1.23", "-1.23", "2.50", "-2.50", "0.99")]
    assert values(amounts.round_number(F.col("x")), rows, "x decimal(10,3)") == [1, -1, 3, -3, 1]


def test_unit_volume_keeps_fractions_of_a_centimetre(values):
    got = values(
        amounts.unit_volume(F.col("a"), F.col("b"), F.col("c")),
        [(Decimal("10.5"), Decimal("20.5"), Decimal("30.5")), (None, Decimal(1), Decimal(1))],
        "a decimal(18,6), b decimal(18,6), c decimal(18,6)",
    )
    assert got == [Decimal("0.006565125"), None]


def test_decimal_comma_and_bad_cells(spark, values):
    rows = [("12,5",), (" 7 ",), ("1.234,5",), ("x",), ("",), (None,)]
    got = values(amounts.parse_decimal_comma(F.col("s")), rows, "s string")
    assert got == [Decimal("12.5"), Decimal(7), None, None, None, None]
    df = spark.createDataFrame(rows, "s string")
    assert amounts.bad_decimal_rows(df, ["s"]).first()["s"] == 3


@pytest.mark.parametrize(
    "kind, places, want",
    [
        ("NORMAL", 0, ["1.234.568", "0", "2", "-0", None]),
        ("CUBAGEM", 3, ["1.234.567,8", "0,2", "2,5", "-0,4", None]),
        ("PORCENTAGEM", 1, ["123456780,0%", "25,0%", "250,0%", "-40,0%", None]),
        ("REAL", 2, ["R$ 1.234.567,80", "R$ 0,25", "R$ 2,50", "R$ -0,40", None]),
    ],
)
def test_number_styles(values, kind, places, want):
    rows = [(1234567.8,), (0.25,), (2.5,), (-0.4,), (None,)]
    assert values(display.fmt_ptbr(F.col("x"), kind, places), rows, "x double") == want


def test_unknown_number_style():
    with pytest.raises(ValueError):
        display.fmt_ptbr(F.lit(1), "OTHER")


def test_volume_text(values):
    rows = [(Decimal("0.5"),), (Decimal("12345.6789015"),), (None,)]
    assert values(display.volume_text(F.col("x")), rows, "x decimal(38,10)") == ["0,500000", "12345,678902", None]


def test_text_export(spark):
    df = spark.createDataFrame([(1, None, dt.datetime(2024, 1, 2, 3, 4, 5))], "a int, b string, c timestamp_ntz")
    assert list(display.text_export(df).first()) == ["1", None, "2024-01-02 03:04:05"]
    assert list(display.text_export(df, "None").first()) == ["1", "None", "2024-01-02 03:04:05"]


def test_token_number_needs_two_marks(values):
    rows = [("12",), ("12#3",), ("12#3#x",), ("12#3#x#y",), ("a#3#x",), ("##",), (None,)]
    assert values(codes.token_number(F.col("s"), 0), rows, "s string") == [None, None, 12, 12, None, None, None]
    assert values(codes.token_number(F.col("s"), 1), rows, "s string") == [None, None, 3, 3, 3, None, None]


def test_concat_code_treats_null_as_empty(values):
    rows = [(12, 3), (12, None), (None, 3)]
    assert values(codes.concat_code(F.col("a"), F.col("b")), rows, "a int, b int") == ["123", "12", "3"]


def test_address_blocks(values):
    rows = [
        ("P", "000"), ("P", "037"), ("P", "038"), ("P", "075"), ("P", "076"), ("P", "199"), ("P", "200"),
        ("B", "033"), ("G", "034"), ("B", "067"), ("G", "068"), ("T", "010"), ("P", None),
    ]
    got = values(codes.address_block(F.col("b"), F.col("c")), rows, "b string, c string")
    one, two, three = "1 BLOCO", "2 BLOCO", "3 BLOCO"
    assert got == [one, one, two, two, three, three, "", one, two, two, three, "", ""]


def test_parity_of_text(values):
    assert values(codes.parity(F.col("c")), [("010",), ("011",), ("A01",), (None,)], "c string") == [
        "PAR", "IMPAR", "IMPAR", "IMPAR",
    ]


def test_code_maps(values):
    assert len(codes.CLASS_NAMES) == 25
    assert values(codes.class_name(F.col("c")), [("26TV",), ("26XXX",), (None,)], "c string") == ["TV - IMAGEM", None, None]
    stations = [("MERCADO",), ("POSTO 9",), (None,)]
    assert values(codes.station_label(F.col("c")), stations, "c string") == ["BENS DE CONSUMO", "POSTO 9", None]
    texts = [("Saiu para Entrega",), ("Outro",), ("",), (None,)]
    assert values(codes.delivery_label(F.col("c")), texts, "c string") == ["Saiu_para Entrega", None, None, None]
    kinds = [("INS1",), ("AGE1",), ("IN",), (None,)]
    assert values(codes.appointment_kind(F.col("c")), kinds, "c string") == [
        "LV", "RECEBIMENTO", "RECEBIMENTO", "RECEBIMENTO",
    ]


def test_decode_values_keeps_quotes_and_types(values):
    labels = {"a'b": "it's", "c\\d": "back\\slash"}
    assert values(codes.decode_values(F.col("c"), labels, "x"), [("a'b",), ("c\\d",), (None,)], "c string") == [
        "it's", "back\\slash", "x",
    ]
    assert values(codes.decode_values(F.col("k"), {1: "one"}, F.lit("?")), [(1,), (2,), (None,)], "k bigint") == ["one", "?", "?"]


def test_classify_takes_the_first_match(values):
    rules = [(F.col("x") > 1, "big"), (F.col("x") > 0, "small")]
    assert values(codes.classify(rules, "none"), [(2,), (1,), (0,), (None,)], "x int") == ["big", "small", "none", "none"]
