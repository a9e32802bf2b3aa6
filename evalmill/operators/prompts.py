"""Item ids, sampling, prompt and chat construction."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.draws import below, bits
from evalmill.operators.ordering import running, smallest
from evalmill.session import scratch_path


# --- ids, replicas, slices, samples ---------------------------------------------------------------


def index_items(df: DataFrame, name: str | Column, by: Sequence[str], order: str, split: str | None = None) -> DataFrame:
    """Add ``subdivision`` and a dense 0-based ``idx`` per ``by`` in the order of a numeric id."""
    label = F.lit(name) if isinstance(name, str) else name
    if split:
        label = F.concat_ws("_", label, F.col(split))
    ranked = running(df, by, F.col(order), F.col(order))
    return ranked.withColumn("idx", F.col("rank") - 1).drop("rank").withColumn("subdivision", label)


def replicate(df: DataFrame, n: int, ks: Sequence[int] = (1,)) -> DataFrame:
    """``n`` copies of every item, numbered by ``replica``."""
    if max(ks) > n:
        raise ValueError(f"k = {max(ks)} needs at least that many copies, got n = {n}")
    return df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def take_range(df: DataFrame, spec: str, idx: str = "idx") -> DataFrame:
    """Python-style slice ``[a:b:c]`` of a dense index."""
    found = re.fullmatch(r"\[(-?\d*):(-?\d*)(?::(-?\d*))?\]", spec.replace(" ", ""))
    if not found:
        raise ValueError(f"not a slice: {spec}")
    part = slice(*[int(g) if g else None for g in found.groups()])
    if all(v is None or v >= 0 for v in (part.start, part.stop, part.step)):
        n = 2**62
    else:
        n = (df.agg(F.max(idx)).first()[0] or -1) + 1
    start, stop, step = part.indices(n)
    if step < 0:
        count = max(0, (start - stop - step - 1) // -step)
        start, stop, step = start + (count - 1) * step, start + 1, -step
    return df.filter((F.col(idx) >= start) & (F.col(idx) < stop) & ((F.col(idx) - start) % step == 0))


def sample_exact(df: DataFrame, size: int | float, id_col: str, seed: int | None = None) -> DataFrame:
    """Seeded sample of exactly ``size`` rows; a fraction means that share, <= 0 or >= all means all."""
    total = df.count()
    n = int(size * total) if 0 < size < 1 else int(size)
    if n <= 0 and not 0 < size < 1 or n >= total:
        return df
    key = bits(n if seed is None else seed, F.col(id_col))
    return smallest(df, key, id_col, n) if n else df.limit(0)


def split_normalise(df: DataFrame, train: str | None, test: str | None, split: str = "split") -> DataFrame:
    """Name two splits train and test; a set without splits serves as both."""
    if train is None and test is None:
        return df.withColumn(split, F.explode(F.array(F.lit("train"), F.lit("test"))))
    if train == test:
        return df.filter(F.col(split) == train).withColumn(split, F.explode(F.array(F.lit("train"), F.lit("test"))))
    named = F.when(F.col(split) == train, "train").when(F.col(split) == test, "test")
    return df.withColumn(split, named).filter(F.col(split).isNotNull())


# --- templates ------------------------------------------------------------------------------------


def render(template: str, columns: Mapping[str, Column], blank: Sequence[str] = ()) -> Column:
    """Fill ``{name}`` places; unknown names stay as they are, blanked ones become empty.

    Filled text is never searched for places again.
    """
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1] if re.fullmatch(r"\{\w+\}", piece) else None
        if name in blank and name is not None:
            continue
        if name in columns:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("None")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def columns_of(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


def input_text(inputs: Sequence[str], template: str | None = None) -> Column:
    if template:
        return render(template, {c: F.col(c) for c in inputs})
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in inputs])


def output_text(column: str) -> Column:
    return F.col(column).cast("string")


def render_labels(items: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """One prompt per item and label, as an explode of the few templates."""
    cols = columns_of(items)
    prompts = F.array(
        *[
            F.struct(F.lit(i).alias("label_pos"), F.lit(k).alias("label"), render(v, cols).alias("prompt"))
            for i, (k, v) in enumerate(templates.items())
        ]
    )
    return items.withColumn("_x", F.explode(prompts)).select(*items.columns, "_x.*")


def labels_from_output(items: DataFrame, output: str, limit: int = 1000) -> list[str]:
    """Distinct output values; refuses a column that is not a label."""
    rows = items.select(F.col(output).cast("string").alias("v")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{output} has more than {limit} values, so it is not a label column")
    return sorted(r["v"] for r in rows if r["v"] is not None)


def assemble_demos(edges: DataFrame, train: DataFrame, sep: str = "\n", end: str = "\n") -> DataFrame:
    """Demonstrations(test_id, rank, train_id) joined to train(train_id, text) as one text per test row.

    A test row has at most k demonstrations, so the list is small. A train row
    that serves very many tests is left to adaptive skew join.
    """
    joined = edges.join(train.select("train_id", "text"), "train_id")
    listed = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return joined.groupBy("test_id").agg(
        F.concat(F.array_join(F.transform(listed, lambda s: s["text"]), sep), F.lit(end)).alias("demos")
    )


def render_generation(items: DataFrame, template: str, output: str, demos: DataFrame | None = None) -> DataFrame:
    """Prompt with the answer blanked and the demonstrations at ``{demos}``."""
    rows = items
    if demos is not None:
        rows = rows.join(demos, "test_id", "left")
    else:
        rows = rows.withColumn("demos", F.lit(""))
    rows = rows.withColumn("demos", F.coalesce("demos", F.lit("")))
    return rows.withColumn("prompt", render(template, columns_of(rows), blank=[output])).drop("demos")


def fit_context(edges: DataFrame, budget: int, bare: DataFrame) -> DataFrame:
    """Keep the leading demonstrations while prompt tokens stay within the budget.

    edges(test_id, rank, n_tokens), bare(test_id, base_tokens). A bare prompt
    that is too long simply keeps no demonstration. At most k rows per test.
    """
    w = Window.partitionBy("test_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = edges.join(bare, "test_id").withColumn("used", F.col("base_tokens") + F.sum("n_tokens").over(w))
    return rows.filter(F.col("used") <= budget)


# --- chats ----------------------------------------------------------------------------------------


def to_chat(df: DataFrame, users: Sequence[str], gold: str | None = None) -> DataFrame:
    """Role/content list out of one or several question columns, gold answer last."""
    turns = [F.struct(F.lit("user").alias("role"), F.col(c).cast("string").alias("content")) for c in users]
    if gold:
        turns.append(F.struct(F.lit("assistant").alias("role"), F.col(gold).cast("string").alias("content")))
    return df.withColumn("chat", F.array(*turns))


def rounds_to_chat(df: DataFrame, users: str, assistants: str) -> DataFrame:
    """Zip arrays of user and assistant texts into one chat."""
    zipped = F.transform(
        F.arrays_zip(F.col(users).alias("u"), F.col(assistants).alias("a")),
        lambda z: F.array(
            F.struct(F.lit("user").alias("role"), z["u"].alias("content")),
            F.struct(F.lit("assistant").alias("role"), z["a"].alias("content")),
        ),
    )
    return df.withColumn("chat", F.filter(F.flatten(zipped), lambda m: m["content"].isNotNull()))


def chat_histories(conv: DataFrame, mode: str = "every") -> DataFrame:
    """History before each assistant turn (``every``) or before the last one (``last``).

    One conversation is one dialogue, whose text must fit a prompt anyway.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = conv.withColumn("history", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w))
    rows = rows.filter(F.col("role") == "assistant").withColumnRenamed("text", "gold")
    if mode == "last":
        last = conv.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
        rows = rows.join(last, ["conv_id", "turn"], "left_semi")
    return rows.select("conv_id", "turn", "history", "gold")


def fed_back_histories(conv: DataFrame, answer, turns: Sequence[int]) -> DataFrame:
    """Each assistant turn is answered by ``answer(prompts) -> (conv_id, text)`` and replaces the gold text.

    One pass per turn number at which some assistant speaks, over all conversations at once; the gold
    text is kept. A pass appends its answers, keyed (conv_id, turn), to one table and reads the earlier
    ones from it to rebuild the histories of the conversations that are due: what is written grows with
    the answers, and the conversations themselves are never written.
    """
    spark = conv.sparkSession
    path = scratch_path(spark, "answers")
    kind = conv.schema["conv_id"].dataType.simpleString()
    spoken = {r["turn"] for r in conv.filter("role = 'assistant'").select("turn").distinct().collect()}
    written: list[int] = []

    def told(rows: DataFrame) -> DataFrame:
        """Rows with the answers given so far."""
        if not written:
            return rows
        said = spark.read.schema(f"conv_id {kind}, _said string, turn bigint").parquet(path)
        return rows.join(said, ["conv_id", "turn"], "left").withColumn("text", F.coalesce("_said", "text")).drop("_said")

    for turn in [t for t in turns if t in spoken]:
        due = conv.filter((F.col("turn") == turn) & (F.col("role") == "assistant")).select("conv_id")
        before = told(conv.filter(F.col("turn") < turn).join(due, "conv_id", "left_semi"))
        asked = before.groupBy("conv_id").agg(
            F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("history")
        )
        said = answer(asked).select("conv_id", F.col("text").alias("_said"))
        said.write.parquet(f"{path}/turn={turn}")
        written.append(turn)
    return told(conv.withColumn("gold", F.col("text")))


def pack_rounds(conv: DataFrame) -> DataFrame:
    """User/assistant turns to rows (conv_id, round, user, assistant)."""
    start = F.min("turn")
    first = conv.filter("role <> 'system'").groupBy("conv_id").agg(start.alias("_t0"))
    rows = conv.filter("role <> 'system'").join(first, "conv_id")
    number = F.floor((F.col("turn") - F.col("_t0")) / 2) + 1
    return rows.groupBy("conv_id", number.cast("bigint").alias("round")).agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user"),
        F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("assistant"),
    )


def unpack_rounds(rounds: DataFrame, longest: int | None = None) -> DataFrame:
    """One column per round up to ``longest`` or the longest dialogue, null past a dialogue's end."""
    if longest is None:
        longest = rounds.agg(F.max("round")).first()[0] or 0
    wide = rounds.groupBy("conv_id").pivot("round", list(range(1, longest + 1))).agg(
        F.first("user").alias("user"), F.first("assistant").alias("assistant")
    )
    return wide


def listed_rounds(rounds: DataFrame) -> DataFrame:
    """One array of (round, user, assistant) per dialogue, whatever its length."""
    return rounds.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("round", "user", "assistant"))).alias("rounds"))


def render_chat(conv: DataFrame, roles: Mapping[str, tuple[str, str]], begin: str = "", end: str = "") -> DataFrame:
    """One prompt per conversation, every turn inside its role's marks."""
    marked = F.lit(None).cast("string")
    for role, (left, right) in roles.items():
        marked = F.when(F.col("role") == role, F.concat(F.lit(left), F.col("text"), F.lit(right))).otherwise(marked)
    turns = F.array_sort(F.collect_list(F.struct("turn", marked.alias("text"))))
    body = F.array_join(F.transform(turns, lambda s: s["text"]), "")
    return conv.groupBy("conv_id").agg(F.concat(F.lit(begin), body, F.lit(end)).alias("prompt"))


@dataclass(frozen=True)
class RoleMarks:
    """Marks of a role; ``default`` is its text in a round without a turn of it, ``generate``: the model speaks here."""

    name: str
    begin: str = ""
    end: str = ""
    default: str = ""
    generate: bool = False


def render_rounds(
    conv: DataFrame,
    roles: Sequence[RoleMarks],
    reserved: Sequence[RoleMarks] = (),
    fallback: Mapping[str, str] | None = None,
    begin: str = "",
    end: str = "",
    generate: bool = False,
) -> DataFrame:
    """One prompt per conversation(conv_id, turn, role, text[, turn_begin, turn_end]) from a model's round of ``roles``.

    A round goes through all roles in order; a turn whose role does not come after the last one opens the next round.
    ``reserved`` roles and those in ``fallback`` (shown with the marks of another role) stand between rounds, a turn
    without a role is shown bare, any other role raises. ``turn_begin`` and ``turn_end`` replace a role's marks for a
    turn. With ``generate`` the last round ends behind the opening mark of its first generating role, and neither
    later turns nor ``end`` follow.
    """
    names, n = [r.name for r in roles], len(roles)
    marks = {r.name: r for r in [*roles, *reserved]}
    marks |= {role: marks[other] for role, other in (fallback or {}).items() if role not in marks}
    own = lambda c: F.col(c) if c in conv.columns else F.lit(None).cast("string")

    unknown = F.raise_error(F.concat(F.lit("no marks for role "), F.col("role"))).cast("int")
    place, left, right = F.when(F.col("role").isNull(), F.lit(-1)), F.lit(""), F.lit("")
    for name, r in marks.items():
        hit = F.col("role") == name
        place = place.when(hit, names.index(name) if name in names else -1)
        left, right = F.when(hit, F.lit(r.begin)).otherwise(left), F.when(hit, F.lit(r.end)).otherwise(right)
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        place.otherwise(unknown).alias("place"),
        F.coalesce(own("turn_begin"), left).alias("begin"),
        F.concat(F.coalesce("text", F.lit("")), F.coalesce(own("turn_end"), right)).alias("rest"),
    )
    rows = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    before = lambda i: F.coalesce(F.get("turns", i - 1)["place"], F.lit(-1))

    speaker = next((i for i, r in enumerate(roles) if r.generate), None) if generate else None
    if speaker is not None:
        opens = lambda t, i: F.when((t["place"] >= 0) & ((before(i) < 0) | (t["place"] <= before(i))), i)
        rows = rows.withColumn("cut", F.array_max(F.transform("turns", opens)))
        tail = F.slice("turns", F.col("cut") + 1, F.size("turns"))
        mark = F.get(F.filter(tail, lambda t: t["place"] == speaker), F.lit(0))["begin"]
        asked = F.struct(
            F.lit(None).cast("bigint").alias("turn"),
            F.lit(speaker).alias("place"),
            F.coalesce(mark, F.lit(roles[speaker].begin)).alias("begin"),
            F.lit("").alias("rest"),
        )
        heard = F.filter(tail, lambda t: (t["place"] >= 0) & (t["place"] < speaker))
        short = F.concat(F.slice("turns", F.lit(1), F.col("cut")), heard, F.array(asked))
        rows = rows.withColumn("turns", F.when(F.col("cut").isNull(), F.col("turns")).otherwise(short))

    shown = [r.begin + r.default + r.end for r in roles]
    silent = F.array(*[F.lit("".join(shown[a:b])) for a in range(n + 1) for b in range(n + 1)])
    gap = lambda a, b: F.get(silent, a * (n + 1) + b)  # noqa: E731  roles from a up to b, without turns
    closing = lambda last: F.when(last >= 0, gap(last + 1, F.lit(n))).otherwise("")

    def piece(t: Column, i: Column) -> Column:
        opening = F.when(t["place"] >= 0, gap(F.lit(0), t["place"])).otherwise("")
        same = (before(i) >= 0) & (t["place"] > before(i))
        lead = F.when(same, gap(before(i) + 1, t["place"])).otherwise(F.concat(closing(before(i)), opening))
        return F.concat(lead, t["begin"], t["rest"])

    tail_text = F.concat(closing(before(F.size("turns"))), F.lit(end))
    if speaker is not None:
        tail_text = F.when(F.col("cut").isNull(), tail_text).otherwise("")
    body = F.array_join(F.transform("turns", piece), "")
    return rows.select("conv_id", F.concat(F.lit(begin), body, tail_text).alias("prompt"))


# --- options --------------------------------------------------------------------------------------


def circular_patterns(letters: str) -> list[str]:
    return [letters[i:] + letters[:i] for i in range(len(letters))]


def all_patterns(letters: str) -> list[str]:
    from itertools import permutations

    return ["".join(p) for p in permutations(letters)]


def apply_pattern(options: Column, gold: Column, pattern: Column, letters: str) -> tuple[Column, Column]:
    """Place ``i`` shows the option the pattern names there; the gold letter follows its text."""
    index = F.transform(
        F.filter(F.split(pattern, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(letters))
    )
    shown = F.transform(index, lambda i: F.get(options, i - 1))
    place = F.position(gold, pattern)
    moved = F.when((F.length(gold) == 1) & (place > 0), F.substr(F.lit(letters), place, F.lit(1))).otherwise(gold)
    return shown, moved


def rotate_options(df: DataFrame, mode: str = "circular", options: str = "options", gold: str = "gold", k: int = 4) -> DataFrame:
    """k rotations or all k! orders of the options of every item, with the gold letter moved along."""
    letters = "ABCDEFGHIJ"[:k]
    patterns = circular_patterns(letters) if mode == "circular" else all_patterns(letters)
    rows = df.withColumn("circular_pattern", F.explode(F.array(*[F.lit(p) for p in patterns])))
    shown, moved = apply_pattern(F.col(options), F.col(gold), F.col("circular_pattern"), letters)
    return rows.withColumn("_shown", shown).withColumn("_moved", moved).drop(options, gold).withColumnsRenamed(
        {"_shown": options, "_moved": gold}
    )


def cycle_options(df: DataFrame, number: str, options: str = "options", gold: str = "gold", k: int = 4) -> DataFrame:
    """Row ``number`` takes rotation ``number mod k``."""
    letters = "ABCDEFGHIJ"[:k]
    patterns = F.array(*[F.lit(p) for p in circular_patterns(letters)])
    rows = df.withColumn("circular_pattern", F.get(patterns, F.pmod(F.col(number), F.lit(k)).cast("int")))
    shown, moved = apply_pattern(F.col(options), F.col(gold), F.col("circular_pattern"), letters)
    return rows.withColumn("_shown", shown).withColumn("_moved", moved).drop(options, gold).withColumnsRenamed(
        {"_shown": options, "_moved": gold}
    )


def shuffle_options(df: DataFrame, seed: int, id_col: str, options: str = "options", gold: str = "gold", k: int = 4) -> DataFrame:
    """Seeded order of the options per item, gold letter moved along."""
    letters = "ABCDEFGHIJ"[:k]
    keys = F.array(*[F.lit(c) for c in letters])
    order = F.array_sort(
        F.transform(keys, lambda c: F.struct(bits(seed, F.col(id_col), c).alias("h"), c.alias("c")))
    )
    rows = df.withColumn("circular_pattern", F.array_join(F.transform(order, lambda s: s["c"]), ""))
    shown, moved = apply_pattern(F.col(options), F.col(gold), F.col("circular_pattern"), letters)
    return rows.withColumn("_shown", shown).withColumn("_moved", moved).drop(options, gold).withColumnsRenamed(
        {"_shown": options, "_moved": gold}
    )


def balance_positions(pairs: DataFrame, seed: int, id_col: str, a: str = "model_a", b: str = "model_b") -> DataFrame:
    """Swap the sides of exactly half of the pairs (an odd rest falls by hash)."""
    n = pairs.count()
    half = n // 2 + (n % 2) * (seed % 2)
    key = bits(seed, F.col(id_col))
    swapped = smallest(pairs, key, id_col, half).select(id_col).withColumn("swapped", F.lit(True))
    rows = pairs.join(swapped, id_col, "left").withColumn("swapped", F.coalesce("swapped", F.lit(False)))
    return _swap(rows, F.col("swapped"), a, b)


def _swap(df: DataFrame, flag: Column, a: str, b: str) -> DataFrame:
    rows = df.withColumn("_a", F.when(flag, F.col(b)).otherwise(F.col(a)))
    rows = rows.withColumn("_b", F.when(flag, F.col(a)).otherwise(F.col(b)))
    return rows.drop(a, b).withColumnsRenamed({"_a": a, "_b": b})


def order_answers(pairs: DataFrame, mode: str, id_col: str = "item_id", seed: int = 0) -> DataFrame:
    """``random``: sides by hash; ``double``: every pair also with its sides swapped."""
    if mode == "random":
        flag = below(2, seed, F.col(id_col), F.col("model_a"), F.col("model_b")) == 1
        rows = pairs.withColumn("swapped", flag)
    else:
        rows = pairs.withColumn("swapped", F.explode(F.array(F.lit(False), F.lit(True))))
    rows = _swap(rows, F.col("swapped"), "model_a", "model_b")
    if "answer_a" in pairs.columns:
        rows = _swap(rows, F.col("swapped"), "answer_a", "answer_b")
    return rows


def fan_out_prompts(items: DataFrame, prompts: str = "judge_prompts", slot: str = "{prediction}", text: str = "prediction") -> DataFrame:
    """One judging row per judge prompt of the item, the prediction filled in."""
    rows = items.select("*", F.posexplode(prompts).alias("prompt_no", "_p")).drop(prompts)
    return rows.withColumn("prompt", F.replace("_p", F.lit(slot), F.col(text))).drop("_p")


def stack_original(df: DataFrame, columns: Sequence[str], prefix: str = "original_") -> DataFrame:
    """Perturbed rows that have an original, and below them the originals, told apart by ``variant``."""
    has = F.lit(False)
    for c in columns:
        has = has | F.col(prefix + c).isNotNull()
    kept = df.filter(has)
    plain = [c for c in df.columns if not c.startswith(prefix)]
    original = kept.select(
        *[F.coalesce(F.col(prefix + c), F.col(c)).alias(c) if c in columns else F.col(c) for c in plain]
    )
    return kept.select(*plain, F.lit("perturbed").alias("variant")).unionByName(
        original.withColumn("variant", F.lit("original"))
    )


def dedup_items(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` per key, by a partial aggregate rather than a sort."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_r")
    return df.groupBy(key).agg(first).select(key, "_r.*").select(*df.columns)


def line_pairs(lines: DataFrame, by: Sequence[str], number: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Question/answer rows forwards (next line) and backwards (previous line).

    Consecutive numbers are matched by an equi-join, so a very long document is not one task.
    """
    left = lines.select(*by, number, F.col(text).alias("first"), *keep)
    right = lines.select(*by, (F.col(number) - 1).alias(number), F.col(text).alias("second"))
    both = left.join(right, [*by, number])
    pair = F.explode(
        F.array(
            F.struct(F.lit("forward").alias("direction"), F.col("first").alias("question"), F.col("second").alias("answer")),
            F.struct(F.lit("reverse").alias("direction"), F.col("second").alias("question"), F.col("first").alias("answer")),
        )
    )
    return both.select(*by, number, *keep, pair.alias("_p")).select(*by, number, *keep, "_p.*")


def move_boundary_spaces(context: Column, continuation: Column) -> tuple[Column, Column]:
    """Spaces at the end of the context go to the start of the continuation."""
    trimmed = F.regexp_replace(context, r"\s+$", "")
    spaces = F.substr(context, F.length(trimmed) + 1)
    return trimmed, F.concat(spaces, continuation)


def length_features(text: Column) -> dict[str, Column]:
    """Counts of CJK characters and of Latin words."""
    return {
        "cn_chars": F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")),
        "en_words": F.regexp_count(text, F.lit("[A-Za-z]+")),
    }


# fixed values: markdown marks counted as style
STYLE_MARKS = {
    "h1": r"(?m)^#{1}\s", "h2": r"(?m)^#{2}\s", "h3": r"(?m)^#{3}\s", "h4": r"(?m)^#{4}\s", "h5": r"(?m)^#{5}\s",
    "h6": r"(?m)^#{6}\s", "ordered": r"(?m)^\s*\d+\.\s", "unordered": r"(?m)^\s*[-*+]\s",
    "bold_star": r"\*\*[^*\n]+\*\*", "bold_bar": r"__[^_\n]+__",
}


def style_features(text: Column, tokens: Column | None = None) -> dict[str, Column]:
    """Token count and markdown counts, both with fenced code left out."""
    prose = F.regexp_replace(text, r"(?s)```.*?```", "")
    counts = {k: F.regexp_count(prose, F.lit(p)) for k, p in STYLE_MARKS.items()}
    counts["tokens"] = tokens if tokens is not None else F.regexp_count(prose, F.lit(r"\S+"))
    return counts


def filter_dates(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows dated in the closed range; plain comparisons, so parquet can skip row groups."""
    if start:
        df = df.filter(F.col(column) >= F.to_timestamp(F.lit(start)))
    if end:
        df = df.filter(F.col(column) <= F.to_timestamp(F.lit(end)))
    return df


def stop_and_clean(text: Column, stops: Sequence[str]) -> Column:
    """Text before the first of any stop word."""
    for word in stops:
        text = F.substring_index(text, word, 1)
    return text
