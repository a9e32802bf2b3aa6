import pytest
from pyspark.sql import functions as F

from evalmill.functions import extract as E


def run(spark, rule, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, prediction string")
    return [r["answer"] for r in E.extract(df, rule).orderBy("i").collect()]


def brute_boxed(text):
    at = text.rfind("\\boxed")
    mark = "\\boxed"
    if at < 0:
        at, mark = text.rfind("\\fbox"), "\\fbox"
    if at < 0 or text[at + len(mark) : at + len(mark) + 1] != "{":
        return None
    depth = 0
    for i in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0 and text[i] == "}":
            return text[at + len(mark) + 1 : i]
    return None


def test_last_boxed(spark):
    texts = [
        r"\boxed{1} and \boxed{\frac{a}{b}} }", r"\boxed{open", "none", r"\fbox{x{y}}", r"\boxed{a{b{c{d{e{f}}}}}} tail",
        r"\boxed{}", r"\boxed{{}{}} {", r"\boxed{a{b}", "\\boxed{two\nlines}",
    ]
    assert run(spark, E.last_boxed, *texts) == [brute_boxed(t) for t in texts]


def test_strip_reasoning(spark):
    got = run(spark, E.strip_reasoning(), "This is a test.</think> How are you?", "Start<think>why\nnot</think> End", "a<think>x</think>b<think>y</think>c", "plain")
    assert got == ["How are you?", "Start End", "abc", "plain"]


def test_first_option(spark):
    got = run(
        spark, E.first_option("ABCD"), "答案是 C", "The answer is (B)", "I choose D: yes", "所以 A。", "no letter", "", "ANSWER: C",
        "The correct answer is \\boxed{D}", "故选B", "B",
    )
    assert got == ["C", "B", "D", "A", "", "", "C", "D", "B", "B"]


def test_general_and_numbers(spark):
    assert run(spark, E.general, "The  cat, a dog", "été d'un jour.", "") == ["cat", "été dun jour", ""]
    assert run(spark, E.last_number, "1 2.5 Question: 9", "The Answer is: -3.5 then 7", "none") == ["2.5", "-3.5", "NULL"]
    assert run(spark, E.first_number, "x -3.25 4", "none") == [-3.25, None]


def test_final_answer(spark):
    got = run(
        spark, E.final_answer, r"so \boxed{{7}}", "We add. The final answer is $1,000$ dollars. Bye", "12 units", r"the answer is \frac12",
    )
    assert got == ["7", "1000", "12", r"\frac{1}{2}"]


def test_verdicts(spark):
    assert run(spark, E.verdict("arena"), "x [[A>>B]]", "[[C]]") == ["A>>B", None]
    assert run(spark, E.verdict("winner"), '"winner":"A" "winner": "B"', "") == ["B", None]
    assert run(spark, E.verdict("grade"), "B", "dunno") == ["B", "C"]
    assert run(spark, E.verdict("rating"), "[[5.5]]", "[[x]]") == ["5.5", None]


def test_checklist(spark):
    ok = '```json\n[{"checklist_id":0,"evaluation_score":0.5},{"checklist_id":1,"evaluation_score":1}]\n```'
    got = run(spark, E.checklist_scores(2), ok, ok.replace("0.5", "1.5"), "[]", "text")
    assert got == [[0.5, 1.0], None, None, None]


def test_entities(spark):
    df = spark.createDataFrame([("a:1;b:x:y", "a: 1 \nb:无\n")], "g string, p string")
    r = df.select(E.gold_entities(F.col("g")).alias("g"), E.predicted_entities(["a", "b", "c"])(F.col("p")).alias("p")).first()
    assert r["g"] == {"a": "1", "b": "x:y"} and r["p"] == {"a": "1"}


def test_arrays_are_extracted_element_by_element(spark):
    df = spark.createDataFrame([(["xA", "B y"],)], "prediction array<string>")
    assert E.extract(df, E.first_run).first()["answer"] == ["A", "B"]


def test_code_and_tags(spark):
    assert run(spark, E.code_block, "a\n```python\nx = 1\n```\n", "bare") == ["x = 1\n", "bare"]
    assert run(spark, E.xml_tag("c"), "<c> 1 </c><c>\n2</c>", "none") == ["2", "NO ANSWER FOUND"]
    assert run(spark, E.role_span("<b>", "<e>"), "x<b>y<e>z", "plain<e>z") == ["y", "plain"]


@pytest.mark.parametrize("rule", [E.general, E.last_boxed, E.final_answer, E.answer_choice, E.answer_freeform, E.code_block])
def test_null_stays_null(spark, rule):
    df = spark.createDataFrame([(None,)], "prediction string")
    assert E.extract(df, rule).first()["answer"] is None
