"""Long-context test sets built from given texts and words.

A prompt is bounded by its context length, so gathering one prompt's pieces
into an array is safe; what is drawn from a large table is drawn by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.draws import below, bits, in_drawn_order, uniform
from evalmill.operators.retrieve import dense_index, draw_distinct
from evalmill.session import pin


def haystacks(docs: DataFrame, length: int, repeats: int, tokens: str = "tokens", doc_id: str = "doc_id") -> DataFrame:
    """Per repeat, documents in drawn order joined until ``length`` tokens are reached.

    All repeats come from one scan. A histogram of tokens over the leading 16 bits of the draws, the
    only thing that reaches the driver, says which documents can be needed; no others move.
    """
    size = F.size(tokens)
    drawn = docs.filter(size > 0).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = drawn.withColumn("_h", bits(0, "repeat", doc_id))
    digit = F.shiftright("_h", 44)
    cuts = [0] * repeats
    held = [0] * repeats
    found = drawn.groupBy("repeat", digit.alias("d")).agg(F.sum(size).alias("n")).collect()
    for r in sorted(found, key=lambda r: r["d"]):
        if held[r["repeat"]] < length:
            held[r["repeat"]] += r["n"]
            cuts[r["repeat"]] = r["d"]
    near = drawn.filter(digit <= F.get(F.array(*[F.lit(c) for c in cuts]), F.col("repeat")))
    near = near.select("repeat", "_h", doc_id, F.slice(tokens, 1, length).alias("_t"))
    w = Window.partitionBy("repeat").orderBy("_h", doc_id).rowsBetween(Window.unboundedPreceding, -1)
    used = near.withColumn("_before", F.coalesce(F.sum(F.size("_t")).over(w), F.lit(0))).filter(F.col("_before") < length)
    listed = F.array_sort(F.collect_list(F.struct("_before", "_t")))
    return used.groupBy("repeat").agg(F.slice(F.flatten(F.transform(listed, lambda s: s["_t"])), 1, length).alias("haystack"))


def insert_at(tokens: Column, piece: Column, place: Column) -> Column:
    """``piece`` put in after the first ``place`` elements."""
    rest = F.slice(tokens, place + 1, F.greatest(F.size(tokens) - place, F.lit(0)))
    return F.concat(F.slice(tokens, F.lit(1), place), piece, rest)


QUESTION_END = "{context}\n\nBased on the text above, now please answer: {question}"
QUESTION_START = "First read the question, then the text: {question}\n\n{context}"


def ask(context: Column, question: Column, where: str) -> Column:
    left, middle, right = (F.lit(x) for x in _pieces(QUESTION_END if where == "End" else QUESTION_START))
    return F.concat(left, context, middle, question, right) if where == "End" else F.concat(left, question, middle, context, right)


def _pieces(template: str) -> list[str]:
    import re

    return re.split(r"\{\w+\}", template)


def needle_haystack(
    docs: DataFrame, needles: DataFrame, lengths: Sequence[int], depths: Sequence[int], repeats: int, buffer: int = 0, where: str = "End"
) -> DataFrame:
    """One prompt per repeat x length x depth: the repeat's needle put at depth percent of its haystack.

    ``needles(repeat, needle array<string>, question, keyword)``, one per repeat.
    """
    stacks = haystacks(docs, max(lengths), repeats).join(needles, "repeat")
    grid = F.explode(F.flatten(F.array(*[F.array(*[F.struct(F.lit(n).alias("length"), F.lit(d).alias("depth")) for d in depths]) for n in lengths])))
    rows = stacks.select("*", grid.alias("_g")).select("repeat", "haystack", "needle", "question", "keyword", "_g.*")
    room = F.greatest(F.col("length") - buffer - F.size("needle"), F.lit(0))
    rows = rows.withColumn("haystack", F.slice("haystack", F.lit(1), room))
    place = F.floor(F.size("haystack") * F.col("depth") / 100).cast("int")
    context = F.array_join(insert_at(F.col("haystack"), F.col("needle"), place), " ")
    return rows.select(
        "repeat", "length", "depth", ask(context, F.col("question"), where).alias("prompt"),
        F.concat_ws("*", F.array_join("needle", " "), "keyword").alias("answer"),
    )


def multi_needle(stacks: DataFrame, depth: int, diff: int) -> DataFrame:
    """Several needles per haystack: the first at ``depth`` percent, each next ``diff`` percent further.

    ``stacks(..., haystack array<string>, needles array<array<string>>)``.
    """
    total = F.size("haystack")
    start = F.struct(F.col("haystack").alias("text"), F.floor(total * depth / 100).cast("int").alias("place"))

    def step(acc: Column, needle: Column) -> Column:
        at = F.least(acc["place"], F.size(acc["text"]))
        text = insert_at(acc["text"], needle, at)
        further = (at + F.size(needle) + F.floor(total * diff / 100)).cast("int")
        return F.struct(text.alias("text"), further.alias("place"))

    return stacks.withColumn("context", F.array_join(F.aggregate("needles", start, step)["text"], " "))


def parallel_needles(stacks: DataFrame, depths: Sequence[int]) -> DataFrame:
    """Needle i at depth i percent of the bare haystack; ``answer`` lists keywords and depths."""
    total = F.size("haystack")
    places = F.array(*[F.floor(total * d / 100).cast("int") for d in depths])
    pairs = F.zip_with("needles", places, lambda n, p: F.struct(p.alias("p"), n.alias("n")))
    # deepest first, so that earlier places stay valid
    context = F.aggregate(F.reverse(F.array_sort(pairs)), F.col("haystack"), lambda acc, s: insert_at(acc, s["n"], s["p"]))
    answer = F.concat(F.array_join("keywords", "*"), F.lit("#" + "*".join(str(d) for d in depths)))
    return stacks.withColumn("context", F.array_join(context, " ")).withColumn("answer", answer)


# own wordings of a parent relation
RELATIONS = ["father", "mother", "dad", "mom"]
RELATION_TEXTS = ["{a} is the {r} of {b}. ", "{b} calls {a} {r}. ", "For {b}, the {r} is {a}. "]


def kinship_chains(items: DataFrame, names: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """A random chain of ``n`` names per item, its relations shuffled; the first name is the answer."""
    listed = F.array(*[F.lit(x) for x in names])
    places = draw_distinct(F.col("item_id"), len(names), n, seed)
    rows = items.select("item_id", F.transform(places, lambda i: F.get(listed, i.cast("int"))).alias("chain"))
    pick = lambda size, salt, i: F.floor(uniform(seed + salt, F.col("item_id"), i) * size).cast("int")

    def fragment(i: Column) -> Column:
        a, b = F.get(F.col("chain"), i), F.get(F.col("chain"), i + 1)
        relation = F.get(F.array(*[F.lit(r) for r in RELATIONS]), pick(len(RELATIONS), 1, i))
        text = F.get(F.array(*[F.lit(x) for x in RELATION_TEXTS]), pick(len(RELATION_TEXTS), 2, i))
        text = F.replace(F.replace(text, F.lit("{a}"), a), F.lit("{b}"), b)
        return F.replace(text, F.lit("{r}"), relation)

    fragments = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), fragment)
    story = F.array_join(in_drawn_order(fragments, seed + 3, F.col("item_id")), "")
    question = F.concat(F.lit("\nWho is the eldest relative that '"), F.get("chain", F.lit(n - 1)), F.lit("' can trace back to?"))
    return rows.select("item_id", F.concat(story, question).alias("prompt"), F.get("chain", F.lit(0)).alias("answer"), "chain")


# fixed value: the sentence that holds a key's value
NEEDLE_TEXT = "One of the special magic numbers for {key} is: {value}."


def key_value_needles(
    items: DataFrame, noise: Column, n_noise: int, keys: int = 4, values: int = 2, queries: int = 2, seed: int = 0, decoys: bool = False
) -> DataFrame:
    """Keys with several magic numbers each, scattered in order over noise lines; some keys are asked for.

    With ``decoys`` the noise lines are needles of other keys. ``noise`` is an array column (essay
    sentences or one repeated line); it is repeated up to ``n_noise`` lines.
    """
    item = F.col("item_id")
    key = lambda i: F.concat(F.lit("key-"), F.hex(below(1 << 40, seed, item, i)))
    value = lambda i, j: (below(9_000_000, seed + 1, item, i, j) + 1_000_000).cast("string")
    head, middle, end = _pieces(NEEDLE_TEXT)
    say = lambda k, v: F.concat(F.lit(head), k, F.lit(middle), v, F.lit(end))
    span = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    needles = F.flatten(F.transform(span(keys), lambda i: F.transform(span(values), lambda j: say(key(i), value(i, j)))))
    if decoys:
        lines = F.transform(span(n_noise), lambda i: say(key(i + 1_000_000), value(i + 1_000_000, F.lit(0))))
    else:
        lines = F.transform(span(n_noise), lambda i: F.get(noise, F.pmod(i, F.greatest(F.size(noise), F.lit(1)))))
    rows = items.withColumn("_needles", in_drawn_order(needles, seed + 2, item)).withColumn("_lines", lines)
    places = F.array_sort(draw_distinct(item, n_noise, keys * values, seed + 3))
    pairs = F.zip_with("_needles", places, lambda n, p: F.struct(p.cast("int").alias("p"), n.alias("n")))
    context = F.aggregate(
        F.reverse(F.array_sort(pairs)), F.col("_lines"), lambda acc, s: insert_at(acc, F.array(s["n"]), s["p"])
    )
    asked = draw_distinct(item, keys, queries, seed + 4)
    query = F.array_join(F.transform(asked, lambda i: key(i.cast("int"))), " and ")
    answers = F.flatten(F.transform(asked, lambda i: F.transform(span(values), lambda j: value(i.cast("int"), j))))
    prompt = F.concat(F.array_join(context, "\n"), F.lit("\nWhat are all the special magic numbers for "), query, F.lit("?"))
    return rows.select("item_id", prompt.alias("prompt"), answers.alias("answers"))


def variable_chains(items: DataFrame, noise: str, n_noise: int, chains: int = 1, hops: int = 4, seed: int = 0) -> DataFrame:
    """Chains of assignments, each scattered in order over noise lines; the answer is the first chain's variables."""
    item = F.col("item_id")
    name = lambda c, h: F.concat(F.lit("V"), F.hex(below(1 << 36, seed, item, F.lit(c * 1000 + h))))
    number = lambda c: (below(89_999, seed + 1, item, F.lit(c)) + 10_000).cast("string")
    lines = F.array_repeat(F.lit(noise), n_noise)
    context = lines
    for c in range(chains):
        first = F.concat(F.lit("VAR "), name(c, 0), F.lit(" = "), number(c))
        rest = [F.concat(F.lit("VAR "), name(c, h + 1), F.lit(" = VAR "), name(c, h)) for h in range(hops)]
        places = F.array_sort(draw_distinct(item, n_noise + c * (hops + 1), hops + 1, seed + 2 + c))
        pairs = F.zip_with(F.array(first, *rest), places, lambda n, p: F.struct(p.cast("int").alias("p"), n.alias("n")))
        context = F.aggregate(F.reverse(F.array_sort(pairs)), context, lambda acc, s: insert_at(acc, F.array(s["n"]), s["p"]))
    prompt = F.concat(
        F.array_join(context, " "), F.lit("\nFind all variables that are assigned the value "), number(0), F.lit(" in the text above.")
    )
    answers = F.array(*[name(0, h) for h in range(hops + 1)])
    return items.select("item_id", prompt.alias("prompt"), answers.alias("answers"))


def draw_words(items: DataFrame, vocabulary: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` different words per item out of vocabulary(idx, word), as an array in drawn order."""
    total = vocabulary.count()
    drawn = items.select("item_id", F.posexplode(draw_distinct(F.col("item_id"), total, n, seed)).alias("_i", "idx"))
    listed = F.array_sort(F.collect_list(F.struct("_i", "word")))
    return drawn.join(vocabulary, "idx").groupBy("item_id").agg(F.transform(listed, lambda s: s["word"]).alias("words"))


def word_vocabulary(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct words with a dense ``idx`` in drawn order."""
    words = docs.select(F.explode(F.array_distinct(tokens)).alias("word")).distinct()
    # numbering reads its input several times, so the distinct words are written once
    return dense_index(pin(words.withColumn("_h", bits(0, "word"))), "_h").select("idx", "word")


def common_words(items: DataFrame, vocabulary: DataFrame, n_words: int = 40, common: int = 10, often: int = 30, rarely: int = 3, seed: int = 0) -> DataFrame:
    """Numbered word list in which the first ``common`` drawn words are repeated often, the others rarely."""
    rows = draw_words(items, vocabulary, n_words, seed)
    copies = F.flatten(F.transform("words", lambda w, i: F.array_repeat(w, F.when(i < common, often).otherwise(rarely))))
    rows = rows.withColumn("_list", in_drawn_order(copies, seed + 5, F.col("item_id")))
    numbered = F.array_join(F.transform("_list", lambda w, i: F.concat_ws(". ", i + 1, w)), " ")
    return rows.select(
        "item_id", F.concat(numbered, F.lit(f"\nWhat are the {common} most common words in the above list?")).alias("prompt"),
        F.slice("words", 1, common).alias("answers"),
    )


def frequent_words(items: DataFrame, vocabulary: DataFrame, n_vocab: int = 50, n_words: int = 300, alpha: float = 2.0, seed: int = 0) -> DataFrame:
    """Word of rank r appears int(n r^-alpha / zeta(alpha)) times; rank 1 is the noise word, ranks 2-4 are the answer."""
    zeta = sum(i**-alpha for i in range(1, 200_000))
    counts = [int(n_words * r**-alpha / zeta) for r in range(1, n_vocab + 1)]
    rows = draw_words(items, vocabulary, n_vocab - 1, seed)
    ranked = F.concat(F.array(F.lit("...")), F.col("words"))
    times = F.array(*[F.lit(c) for c in counts])
    copies = F.flatten(F.zip_with(ranked, times, lambda w, n: F.array_repeat(w, F.coalesce(n, F.lit(0)))))
    text = F.array_join(in_drawn_order(copies, seed + 5, F.col("item_id")), " ")
    return rows.select("item_id", text.alias("prompt"), F.slice("words", 1, 3).alias("answers"))


def distractor_qa(
    questions: DataFrame, docs: DataFrame, budget: int, pool: int = 16, seed: int = 0, tokens: str = "n_tokens"
) -> DataFrame:
    """Gold documents plus random others up to a token budget, shuffled.

    ``questions(item_id, question, answer, gold array<bigint>)``, ``docs(doc_id, text, n_tokens)``.
    Gold documents come first and always stay. A question draws places of the document list, skips
    what it has drawn before, and stops before the document that no longer fits. It draws ``pool``
    places, then twice as many, and so on, as long as it has budget left; questions that are full or
    have met every document draw no more. Only ids and lengths take part; texts are joined at the end.
    """
    index = pin(dense_index(docs.select("doc_id", F.col(tokens).alias("_n")), "doc_id"))
    total = index.count()
    gold = questions.select("item_id", F.posexplode("gold").alias("_i", "doc_id")).join(index.select("doc_id", "_n"), "doc_id")
    start = gold.select("item_id", (F.col("_i") - (1 << 30)).cast("bigint").alias("place"), "doc_id", "_n", F.lit(True).alias("keeps"))
    taken = pin(start)
    own = questions.select("item_id")
    low, high = 0, pool
    while True:
        state = taken.groupBy("item_id").agg(F.sum(F.when(F.col("keeps"), F.col("_n")).otherwise(0)).alias("used"), F.count(F.lit(1)).alias("met"), F.bool_and("keeps").alias("room"))
        open_ = pin(own.join(state, "item_id", "left").select("item_id", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("met", F.lit(0)).alias("met"), F.coalesce("room", F.lit(True)).alias("room")))
        open_ = open_.filter((F.col("used") < budget) & F.col("room") & (F.col("met") < total))
        if open_.isEmpty():
            break
        places = F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high - 1).cast("bigint")))
        drawn = open_.select("item_id", "used", places.alias("place")).withColumn("idx", below(total, seed, "item_id", "place"))
        first = drawn.groupBy("item_id", "used", "idx").agg(F.min("place").alias("place")).join(index, "idx")
        fresh = first.join(taken.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
        # a question's draws of one round are bounded by what its budget asked for
        w = Window.partitionBy("item_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = fresh.withColumn("_sum", F.col("used") + F.sum("_n").over(w))
        marked = summed.withColumn("keeps", F.col("_sum") <= budget)
        # the first document that does not fit is noted: it ends the question
        ended = marked.withColumn("_over", F.sum(F.when(F.col("keeps"), 0).otherwise(1)).over(w)).filter(F.col("_over") <= 1)
        taken = pin(taken.unionByName(ended.select("item_id", "place", "doc_id", "_n", "keeps")))
        low, high = high, 3 * high - 2 * low
    rows = taken.filter("keeps").select("item_id", "doc_id").join(docs, "doc_id")
    listed = F.array_sort(F.collect_list(F.struct(bits(seed + 1, "item_id", "doc_id").alias("h"), "doc_id", "text")))
    shown = F.transform(listed, lambda s, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":\n"), s["text"]))
    contexts = rows.groupBy("item_id").agg(
        F.array_join(shown, "\n\n").alias("context"), F.transform(listed, lambda s: s["doc_id"]).alias("doc_ids")
    )
    out = questions.join(contexts, "item_id")
    return out.select("item_id", ask(F.col("context"), F.col("question"), "End").alias("prompt"), "answer", "doc_ids")
