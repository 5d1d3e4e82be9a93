"""Plans that once did the same work again and again."""
from pyspark.sql import functions as F

from cuewright.operators import cast as C
from cuewright.operators import transcript as T


def analysed(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_a_line_is_measured_a_few_times_however_often_it_is_cut(spark):
    ln = spark.createDataFrame([("v", 0, 0, 21_500, "one, two three. four five six seven eight nine")],
                               "vid string, seq long, start_ms long, end_ms long, text string")
    out = T.split_long(ln)
    assert analysed(out).count("length(text#") < 10
    text = "one, two three. four five six seven eight nine"
    assert "".join(r["text"] for r in out.orderBy("part").collect()).replace(" ", "") == text.replace(" ", "")


def test_the_closest_break_wins_and_of_two_the_left_one(spark):
    for text, want in (("aaaaaaaa bb bb aaaaaaaa", 12), ("aaaaaaaa, bb bb aaaaaaaa", 13), ("aaaaaaaaaaa b aaaaaaaaaa", 12), ("aaaaaaaaaaa,b!aaaaaaaaaa", 14), ("aaaaaaaaaaaaaaaaaaaaaa", 11)):
        row = spark.range(1).select(T.split_pieces(F.lit(text), F.lit(8_000)).alias("p")).collect()[0]["p"]
        assert [(p["a"], p["b"]) for p in row] == [(0, want), (want, len(text))], text


def test_a_cast_is_parsed_once(spark):
    replies = spark.createDataFrame([("v", "NPC|甲, 乙|Ann|f|his sister\nMC|丙|Bob|m\nmc|丁|Carl|m"), (None, "MC|戊|Dan|m")], "vid string, content string")
    cast = C.parse_cast(replies)
    assert "Join" not in analysed(cast)
    assert {(r["en"], r["role"]) for r in cast.collect()} == {("Ann", "NPC"), ("Bob", "MC"), ("Carl", "NPC"), ("Dan", "NPC")}


def test_only_the_end_of_a_line_is_searched_for_a_dangling_word(spark):
    from cuewright.functions import fixed as K
    from cuewright.functions import text as X

    ws = f"[{K.WHITESPACE_CLASS}]*"
    whole = rf"(\.\.\.|…){ws}$|(?i)(^|[^\p{{L}}\p{{N}}_])({K.DANGLING_WORDS}){ws}[.,]?{ws}$"
    texts = ["and", "Because", "xbecause", "we go because .", "we go AND,　", "end...", "end… \n", "end.. ", "and..", "and.,", "an", "a,", "the\n",
             "sand", "é and", "éand", "_of", "", " ", None, "...", "was was", "a" * 50 + " while\x1f. ", "if\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.dangling(F.col("t")).alias("now"), F.col("t").rlike(whole).alias("before")).collect()
    assert [r["now"] for r in got] == [r["before"] for r in got]
    assert "right(" in df.select(X.dangling(F.col("t")))._jdf.queryExecution().analyzed().toString()


def test_a_line_is_stripped_once_for_all_its_faults(spark):
    from cuewright.functions import text as X
    from cuewright.operators import audit as Q

    df = spark.createDataFrame([(" and ", "a longer source line than that", 100), ("fine.", "fine", 12), ("  ", "x", 12)], "en string, text string, budget long")
    faults = Q.line_faults(X.strip(F.col("en")), X.strip(F.col("text")), F.col("budget"), F.lit(False), F.lit(False), F.lit(False))
    out = df.select(faults.alias("f"))
    assert [r["f"] for r in out.collect()] == [["unfinished", "dropped"], [], []]
    assert analysed(out).count("trim(en#") == 1
