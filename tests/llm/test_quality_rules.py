"""Quality rules against a plain Python count; edge rows."""

import random
import re

from cargoscope.llm import quality_rules as rules


def count(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(repeat))


def test_measures_equal_plain_count(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t ", "a", "x " * 50000, "é b c\x1cd #|<>&", "\n\n a \n a \r\n a"]
    for _ in range(60):
        texts.append("".join(rnd.choices(["a", "b ", "the ", "\n", "c d ", "\x0b", "&"],
                                         k=rnd.randrange(300))))
    texts += texts[-5:]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)],
                               "doc_id long, text string, Kept string")
    out = rules.apply_rules(df)
    assert [c.lower() for c in out.columns].count("kept") == 1
    for r in out.collect():
        want = count(texts[r["doc_id"]])
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rule_table_is_one_projection_without_python(spark):
    df = spark.createDataFrame([(1, "the cat and the dog " * 2 + "are here")], "id long, text string")
    out = rules.apply_rules(df, [rules.Rule("words", "n_words", "n_lines", low=100)], min_words=1,
                            max_repeat_percent=100)
    row = out.collect()[0]
    assert row["failed_rules"] == ["words"] and row["kept"] is False
    assert rules.apply_rules(df, [], min_words=1, max_repeat_percent=100).collect()[0]["kept"]
    assert rules.apply_rules(df.limit(0)).count() == 0


def test_filter_on_a_measure_does_not_repeat_the_work(spark):
    from cargoscope.session import plan_text
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    plan = plan_text(rules.apply_rules(df).filter("kept and n_repeat_words = 0"))
    assert plan.split("== Physical Plan ==")[1].count("aggregate(") == 1
    assert "Python" not in plan and "Exchange" not in plan
