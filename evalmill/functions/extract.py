"""Answer extraction: rules are functions Column -> Column, applied by ``extract`` as one projection."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions.text import PUNCTUATION, drop_articles, first_match, last_of, let, strip

Rule = Callable[[Column], Column]


def chain(*rules: Rule) -> Rule:
    """Apply rules left to right (model rules first, then the question set's)."""

    def run(text: Column) -> Column:
        for rule in rules:
            text = rule(text)
        return text

    return run


def extract(df: DataFrame, rule: Rule, source: str = "prediction", target: str = "answer") -> DataFrame:
    """Extracted answers of a whole table; arrays of predictions are handled element by element."""
    if df.schema[source].dataType.typeName() == "array":
        return df.withColumn(target, F.transform(source, rule))
    return df.withColumn(target, rule(F.col(source)))


def general(text: Column) -> Column:
    """Text before the first newline, period or comma, without punctuation and articles."""
    head = F.regexp_extract(text, r"^[^\n.,]*", 0)
    return drop_articles(F.regexp_replace(head, r"[^\p{L}\p{N}_\s]", ""))


def qa_normalise(text: Column) -> Column:
    return drop_articles(F.regexp_replace(F.lower(text), PUNCTUATION, ""))


def first_capital(text: Column) -> Column:
    return F.regexp_extract(text, r"\p{Lu}", 0)


def last_capital(text: Column) -> Column:
    return F.coalesce(last_of(F.regexp_extract_all(text, F.lit(r"\p{Lu}"), F.lit(0))), F.lit(""))


def first_run(text: Column) -> Column:
    return F.regexp_extract(text, "[A-D]+", 0)


def capital_set(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\p{Lu}"), F.lit(0))
    return F.array_join(F.array_sort(F.array_distinct(found)), "")


# fixed values: wordings that announce a chosen option, tried in this order; OPT is the option class.
# Each group says whether its wordings need a CJK character.
OPTION_WORDINGS = [
    (True, [
        r"答案是?\s*([OPT])",
        r"答案是?\s*：\s*([OPT])",
        r"答案是?\s*:\s*([OPT])",
        r"答案选项应?该?是\s*([OPT])",
        r"答案选项应?该?为\s*([OPT])",
        r"答案应该?是\s*([OPT])",
        r"答案应该?选\s*([OPT])",
        r"答案选项为?\s*：\s*([OPT])",
        r"答案选项为?\s+\(?\*?\*?([OPT])\*?\*?\)?",
        r"答案选项是?\s*:\s*([OPT])",
        r"答案为\s*([OPT])",
        r"答案选\s*([OPT])",
        r"选择?\s*([OPT])",
        r"故选?\s*([OPT])",
        r"只有选?项?\s?([OPT])\s?是?对",
        r"只有选?项?\s?([OPT])\s?是?错",
        r"只有选?项?\s?([OPT])\s?不?正确",
        r"只有选?项?\s?([OPT])\s?错误",
        r"说法不?对选?项?的?是\s?([OPT])",
        r"说法不?正确选?项?的?是\s?([OPT])",
        r"说法错误选?项?的?是\s?([OPT])",
        r"([OPT])\s?是正确的",
        r"([OPT])\s?是正确答案",
        r"选项\s?([OPT])\s?正确",
        r"所以答\s?([OPT])",
        r"所以\s?([OPT][.。$]?$)",
        r"所有\s?([OPT][.。$]?$)",
    ]),
    (False, [
        r"[\s，：:,]([OPT])[。，,\.]?$",
    ]),
    (True, [
        r"[\s，,：:][故即]([OPT])[。\.]?$",
        r"[\s，,：:]因此([OPT])[。\.]?$",
        r"[是为。]\s?([OPT])[。\.]?$",
        r"因此\s?([OPT])[。\.]?$",
        r"显然\s?([OPT])[。\.]?$",
        r"答案是\s?(\S+)(?:。|$)",
        r"答案应该是\s?(\S+)(?:。|$)",
        r"答案为\s?(\S+)(?:。|$)",
    ]),
    (False, [
        r"(?i)ANSWER\s*:\s*([OPT])",
        r"[Tt]he answer is:?\s+\(?([OPT])\)?",
        r"[Tt]he answer is:?\s+\(?\*?\*?([OPT])\*?\*?\)?",
        r"[Tt]he answer is option:?\s+\(?([OPT])\)?",
        r"[Tt]he correct answer is:?\s+\(?([OPT])\)?",
        r"[Tt]he correct answer is option:?\s+\(?([OPT])\)?",
        r"[Tt]he correct answer is:?.*?boxed\{([OPT])\}",
        r"[Tt]he correct option is:?.*?boxed\{([OPT])\}",
        r"[Tt]he correct answer option is:?.*?boxed\{([OPT])\}",
        r"[Tt]he answer to the question is:?\s+\(?([OPT])\)?",
    ]),
    (True, [
        r"^选项\s?([OPT])",
        r"^([OPT])\s?选?项",
    ]),
    (False, [
        r"((?:\s|^)[OPT][\s。，,：:\.$])",
        r"1.\s?(.+?)$",
        r"(1.\s?)$",
        r"1.\s?([OPT])[.。$]?$",
    ]),
]
OPTION_FALLBACKS = [r"([OPT]):", r"([OPT])"]
CJK = r"[\x{3000}-\x{303f}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}]"


def first_option(options: str = "ABCD", cushion: bool = True) -> Rule:
    """First wording that names an option wins; '' when none does.

    Inside the matched text the first listed option counts. A text without any
    option letter, or without CJK characters, skips the wordings that need them.
    """
    groups = OPTION_WORDINGS + ([(False, OPTION_FALLBACKS)] if cushion else [])

    def rule(text: Column) -> Column:
        trimmed = strip(text)

        def named(pattern: str) -> Column:
            hit = F.regexp_extract(trimmed, "(?s)" + pattern.replace("OPT", options), 1)
            return F.array_min(F.regexp_extract_all(hit, F.lit(f"[{options}]"), F.lit(0)))

        has_cjk = F.regexp_like(trimmed, F.lit(CJK))
        tries = []
        for needs_cjk, patterns in groups:
            found = F.coalesce(*[named(p) for p in patterns])
            tries.append(F.when(has_cjk, found) if needs_cjk else found)
        any_option = F.regexp_like(trimmed, F.lit(f"[{options}]"))
        return F.when(any_option, F.coalesce(*tries, F.lit(""))).otherwise("")

    return rule


def last_option(options: str = "ABCD") -> Rule:
    return lambda text: F.coalesce(
        last_of(F.regexp_extract_all(text, F.lit(f"[{options}]"), F.lit(0))), F.lit("")
    )


NUMBER = r"-?\d+\.\d+|-?\d+"


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"-?\d*\.?\d+", 0).try_cast("double")


def last_number(text: Column) -> Column:
    """Number after ``The Answer is``; else the last number before ``Question:``; else ``NULL``."""
    stated = first_match(text, r"(?i)The Answer is[:\s]*(-?\d+(?:\.\d+)?)")
    head = F.substring_index(text, "Question:", 1)
    found = F.regexp_extract_all(head, F.lit(NUMBER), F.lit(0))
    return F.coalesce(stated, last_of(found), F.lit("NULL"))


def _balanced(depth: int) -> str:
    """Pattern of a text with balanced braces down to ``depth`` nested levels."""
    inner = r"[^{}]*"
    for _ in range(depth):
        inner = r"[^{}]*+(?:\{" + inner + r"\}[^{}]*+)*+"
    return inner


def _to_closing_brace(tail: Column) -> Column:
    """Inside of the brace group that opens ``tail``, any depth: a running brace count."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        at = acc["at"] + 1
        closes = (acc["end"] == 0) & (ch == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(closes, at).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step)["end"]
    return let(end, lambda e: F.when(e > 0, F.substr(tail, F.lit(2), e - 2)))


def last_boxed(text: Column) -> Column:
    r"""Content of the last ``\boxed{...}`` (else ``\fbox``) with balanced braces; null when unclosed.

    A pattern covers three nested levels; only deeper texts count braces.
    """
    group = r"(?s)^\{(" + _balanced(3) + r")\}"

    def content(marker: str) -> Column:
        def inside(tail: Column) -> Column:
            shallow = first_match(tail, group)
            deep = F.when(tail.startswith("{") & F.contains(tail, F.lit("}")), _to_closing_brace(tail))
            return F.coalesce(shallow, deep)

        return let(F.substring_index(text, marker, -1), inside)

    return (
        F.when(F.contains(text, F.lit("\\boxed")), content("\\boxed"))
        .when(F.contains(text, F.lit("\\fbox")), content("\\fbox"))
    )


# fixed values: replacements, dropped expressions and unwrapped commands of final-answer clean-up
FINAL_REPLACE = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"), ("\\le", "<"),
]
FINAL_DROP = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "sue",
    "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges",
    "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2",
    "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"',
    "\\dots", "\n", "\r", "\f",
]
FINAL_UNWRAP = [
    r"\\text\{\((.*?)\)\}", r"\\text\{(.*?)\}", r"\\textbf\{(.*?)\}", r"\\overline\{(.*?)\}", r"\\boxed\{(.*)\}",
]
# what follows the first marker, or the last boxed or dollar-quoted part, replaces the text
FINAL_MARKERS = [
    r"(?s)^.*?finalansweris(.*)$", r"(?s)^.*?answer?is:?(.*)$",
    r"(?s)^(?:.*?oxed\{(.*?)\})+.*$", r"(?s)^(?:.*?\$(.*?)\$)+.*$",
]


def final_normalise(text: Column) -> Column:
    """Clean a final answer: units, spaces, text commands, answer markers, shorthand fractions."""
    for old, new in FINAL_REPLACE:
        text = F.replace(text, F.lit(old), F.lit(new))
    for old in FINAL_DROP:
        text = F.replace(text, F.lit(old), F.lit(""))
    for pattern in [*FINAL_UNWRAP, *FINAL_MARKERS]:
        text = F.regexp_replace(text, pattern, "$1")

    def fraction(t: Column) -> Column:
        bare = F.contains(t, F.lit("rac")) & ~F.contains(t, F.lit("\\frac"))
        return F.when(bare, F.replace(t, F.lit("rac"), F.lit("\\frac"))).otherwise(t)

    def number(t: Column) -> Column:
        return F.when(F.regexp_like(t, F.lit(r"^,*\d[\d,]*$")), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)

    text = let(strip(text), fraction)
    text = F.regexp_replace(text, r"frac([^{])(.)", r"frac{$1}{$2}")
    text = F.regexp_replace(text, r"sqrt([^{])", r"sqrt{$1}")
    return let(F.replace(text, F.lit("$"), F.lit("")), number)


def answer_sentence(text: Column) -> Column:
    """First sentence that announces the answer, else the first sentence."""

    def pick(sentences: Column) -> Column:
        marked = F.filter(sentences, lambda s: F.regexp_like(F.lower(s), F.lit("final answer|answer is")))
        return F.coalesce(F.try_element_at(marked, F.lit(1)), F.element_at(sentences, 1))

    return let(F.split(text, r"\."), pick)


def final_answer(text: Column) -> Column:
    boxed = let(last_boxed(text), lambda b: F.nullif(F.regexp_replace(b, r"(?s)^\{(.*)\}$", "$1"), F.lit("")))
    return F.coalesce(boxed, final_normalise(answer_sentence(text)))


def _after_answer_is(text: Column) -> Column:
    part = F.try_element_at(F.split(text, "answer is "), F.lit(2))
    return F.coalesce(strip(part), text)


def answer_choice(text: Column) -> Column:
    tail = _after_answer_is(text)
    return F.coalesce(first_match(tail, r"\(([A-Z])\)*"), first_match(tail, "([A-Z])"), tail)


def answer_freeform(text: Column) -> Column:
    line = strip(F.element_at(F.split(_after_answer_is(text), "\n"), 1))
    line = F.when(line.endswith("."), strip(F.regexp_replace(line, r"\.$", ""))).otherwise(line)
    return F.coalesce(first_match(line, r"\*\*(.*?)\*\*"), line)


def xml_tag(tag: str) -> Rule:
    name = re.escape(tag)
    return lambda text: F.coalesce(
        strip(last_of(F.regexp_extract_all(text, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1)))),
        F.lit("NO ANSWER FOUND"),
    )


def strip_reasoning(start: str = "<think>", end: str = "</think>") -> Rule:
    block = f"(?s){re.escape(start)}.*?{re.escape(end)}"

    def rule(text: Column) -> Column:
        only_end = ~F.contains(text, F.lit(start)) & F.contains(text, F.lit(end))
        return strip(F.when(only_end, F.substring_index(text, end, -1)).otherwise(F.regexp_replace(text, block, "")))

    return rule


def regex_group(pattern: str, empty_if_missing: bool = False) -> Rule:
    def rule(text: Column) -> Column:
        missing = F.lit("") if empty_if_missing else text
        return F.coalesce(strip(first_match(text, pattern)), missing)

    return rule


def role_span(begin: str | None, end: str | None) -> Rule:
    """Text after the first ``begin`` up to the next ``end``."""

    def rule(text: Column) -> Column:
        if begin:
            at = F.locate(begin, text)
            text = F.when(at > 0, F.substr(text, at + len(begin))).otherwise(text)
        return F.substring_index(text, end, 1) if end else text

    return rule


def code_block(text: Column) -> Column:
    """First fenced block without its language line; the text itself when nothing is fenced."""
    return F.coalesce(first_match(text, r"(?s)```[^\n`]*\n(.*?)```"), text)


# fixed values: one pattern per judge answer style (last match wins where marked)
VERDICT_STYLES = {
    "arena": r"\[\[([AB<>=]+)\]\]",
    "choice": r"Choice: ([ABC])",
    "rating": r"\[\[(\d+(?:\.\d+)?)\]\]",
    "letter": r"^([mM])",
    "json_choice": r'"choice": "(.*?)"',
    "json_score": r'"score": "?(-?\d+(?:\.\d+)?)"?',
    "grade": r"([ABC])",
    "winner": r'"?(?:winner|胜者)"?\s*:\s*"([A-Z])"',
}
LAST_MATCH = {"winner"}


def verdict(style: str) -> Rule:
    """Judge verdict in one of the styles; null when it does not parse (style ``grade``: C)."""
    pattern = VERDICT_STYLES[style]

    def rule(text: Column) -> Column:
        if style in LAST_MATCH:
            return last_of(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        found = first_match(text, pattern)
        return F.coalesce(found, F.lit("C")) if style == "grade" else found

    return rule


def checklist_scores(n: int) -> Rule:
    """``n`` scores in [0, 1] out of a (possibly fenced) JSON list; null if anything is off."""

    def rule(text: Column) -> Column:
        body = F.regexp_extract(text, r"(?s)^\s*(?:```(?:json)?\s*)?(\[.*\])\s*(?:```)?\s*$", 1)
        rows = F.from_json(body, "array<struct<checklist_id:string,evaluation_score:string>>")
        scores = F.transform(rows, lambda r: r["evaluation_score"].try_cast("double"))
        fine = (F.size(scores) == n) & F.forall(scores, lambda s: F.coalesce(s.between(0, 1), F.lit(False)))
        return F.when(fine, scores)

    return rule


# fixed values: words for "none" and "not mentioned"
ENTITY_ABSENT = ["无", "未提及"]


def gold_entities(text: Column) -> Column:
    """``type:value;type:value`` to a map."""
    pairs = F.filter(F.split(text, ";"), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(
        pairs, lambda p: F.struct(F.substring_index(p, ":", 1), F.regexp_replace(p, r"^[^:]*:", ""))
    )
    return F.map_from_entries(entries)


def predicted_entities(types: Sequence[str]) -> Rule:
    """For each wanted type, the word after the last ``type:`` (either width of the colon) that names something."""

    def rule(text: Column) -> Column:
        def last(t: str) -> Column:
            said = F.regexp_extract_all(text, F.lit(rf"{re.escape(t)}[:：](?=(?s:..))\s*([^\n ]*)"), F.lit(1))
            return last_of(F.filter(said, lambda v: (v != "") & ~v.isin(ENTITY_ABSENT)))

        found = F.map_from_arrays(F.array(*[F.lit(t) for t in types]), F.array(*[last(t) for t in types]))
        return F.map_filter(found, lambda _, v: v.isNotNull())

    return rule
