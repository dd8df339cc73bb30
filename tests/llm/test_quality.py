from eventloom.llm import quality
from eventloom.llm.queries import op6_quality_rules


def test_sql(spark, small, duck, same):
    same(op6_quality_rules(spark, small), duck, quality.oracle_sql())


def test_no_user_functions(spark, small):
    plan = op6_quality_rules(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def test_odd_rows(spark):
    words = " ".join(f"the w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a b a b a b"), (5, "x\nx\n\nx\ny"), (6, "# <b> éé"), (7, words), (7, words), (8, "   ")]
    d = spark.createDataFrame([(*r, 99, "k") for r in rows], "doc_id long, text string, n_words int, kept string")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(d).collect())
    n = len(words.replace(" ", ""))
    assert got == [
        (1, 0, 0, 0, 0, 0, True, False),
        (2, 0, 0, 0, 0, 0, True, False),
        (3, 0, 0, 0, 0, 0, True, False),
        (4, 6, 6, 0, 0, 6, True, False),
        (5, 4, 4, 0, 2, 0, True, False),
        (6, 3, 6, 3, 0, 0, True, False),
        (7, 80, n, 0, 0, 0, False, True),
        (7, 80, n, 0, 0, 0, False, True),
        (8, 2, 2, 0, 0, 0, True, False),
    ]
    assert quality.judge(d.limit(0)).collect() == []


def test_rules_are_a_table(spark):
    d = spark.createDataFrame([(1, "the " * 10 + "end")], "doc_id long, text string")
    keep = lambda *r: quality.judge(d.withColumn("x", d.doc_id), rules=r).first()
    assert quality.measures(d).select(quality.compile_rules((quality.Rule("n_words", low=11, high=11),)).alias("k")).first().k
    assert not quality.measures(d).select(quality.compile_rules((quality.Rule("stop_word_ratio", high=0.5),)).alias("k")).first().k
    assert keep().base_failed
