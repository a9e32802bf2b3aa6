"""Queries over item ids, sampling, prompts, chats and options."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.operators import prompts as P
from evalmill.plans import draws_sql as D
from evalmill.plans.catalog import query
from evalmill.plans.fixtures import with_tables

ITEMS = with_tables("ev_items")
PREDS = with_tables("ev_predictions")


@query("b1_index_items", """
SELECT lang || '_' || source AS subdivision, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents""")
def _(t):
    rows = P.index_items(t.documents.select("doc_id", "lang", "source"), F.col("lang"), ["lang"], "doc_id", split="source")
    return rows.select("subdivision", "doc_id", "idx")


@query("b2_replicate", ITEMS + "SELECT item_id, gold, CAST(r AS INT) AS replica FROM ev_items, range(4) x(r)")
def _(t):
    return P.replicate(t.ev_items.select("item_id", "gold"), 4, ks=(1, 4))


@query("b3_take_range", """
WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, idx FROM x WHERE idx >= greatest(n - 300, 0) AND idx < n - 5 AND (idx - greatest(n - 300, 0)) % 7 = 0""")
def _(t):
    rows = P.index_items(t.documents.select("doc_id"), "documents", [], "doc_id").select("doc_id", "idx")
    # at the smallest scale the slice starts before the first row, as in Python
    return P.take_range(rows, "[-300:-5:7]")


@query("b4_sample_exact", D.SAMPLE_EXACT)
def _(t):
    return P.sample_exact(t.orders.select("o_orderkey"), 0.3, "o_orderkey", seed=7)


@query("b5_split_normalise", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'train' ELSE 'test' END AS split FROM documents WHERE lang IN ('en', 'fr')""")
def _(t):
    return P.split_normalise(t.documents.select("doc_id", F.col("lang").alias("split")), "en", "fr")


@query("b6_input_output_text", """
SELECT o_orderkey, o_orderstatus || ' ' || o_orderpriority AS input, CAST(o_custkey AS VARCHAR) AS output FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", P.input_text(["o_orderstatus", "o_orderpriority"]).alias("input"), P.output_text("o_custkey").alias("output")
    )


@query("b7_render", """
SELECT doc_id, 'Source ' || source || ' (' || lang || '), {unknown}: ' || text || ' ' || lang AS prompt FROM documents""")
def _(t):
    template = "Source {source} ({lang}), {unknown}: {text} {lang}"
    return t.documents.select("doc_id", P.render(template, P.columns_of(t.documents)).alias("prompt"))


@query("b8_render_labels", ITEMS + """
SELECT item_id, l AS label, 'Order ' || category || ' is ' || l || '?' AS prompt FROM ev_items, (SELECT DISTINCT difficulty AS l FROM ev_items) x""")
def _(t):
    items = t.ev_items.select("item_id", "category", "difficulty")
    labels = P.labels_from_output(items, "difficulty")
    rows = P.render_labels(items, {v: "Order {category} is " + v + "?" for v in labels})
    return rows.select("item_id", "label", "prompt")


DEMO_EDGES = """
, tr AS (SELECT doc_id AS train_id, lang || ':' || source AS text FROM documents),
n AS (SELECT count(*) AS n FROM documents),
e AS (SELECT item_id AS test_id, r AS rank, (item_id * 7 + r * 13) % n AS train_id FROM benchmark, n, (VALUES (1), (2), (3)) k(r))
"""


def demo_edges(t):
    n = t.documents.count()
    ranks = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))
    edges = t.benchmark.select(F.col("item_id").alias("test_id"), ranks.alias("rank"))
    edges = edges.withColumn("train_id", (F.col("test_id") * 7 + F.col("rank") * 13) % F.lit(n))
    train = t.documents.select(F.col("doc_id").alias("train_id"), F.concat_ws(":", "lang", "source").alias("text"))
    return edges, train


@query("b9_render_generation", "WITH z AS (SELECT 1)" + DEMO_EDGES + """
, d AS (SELECT test_id, string_agg(text, ' ; ' ORDER BY rank) || ' . ' AS demos FROM e JOIN tr USING (train_id) GROUP BY test_id)
SELECT item_id AS test_id, d.demos || 'Q: ' || text || ' A: ' AS prompt FROM benchmark JOIN d ON d.test_id = item_id""")
def _(t):
    edges, train = demo_edges(t)
    demos = P.assemble_demos(edges, train, sep=" ; ", end=" . ")
    items = t.benchmark.select(F.col("item_id").alias("test_id"), F.col("text").alias("question"), F.lit("secret").alias("answer"))
    return P.render_generation(items, "{demos}Q: {question} A: {answer}", "answer", demos).select("test_id", "prompt")


@query("b10_assemble_demos", "WITH z AS (SELECT 1)" + DEMO_EDGES + """
SELECT test_id, string_agg(text, chr(10) ORDER BY rank) || chr(10) AS demos FROM e JOIN tr USING (train_id) GROUP BY test_id""")
def _(t):
    return P.assemble_demos(*demo_edges(t))


@query("b11_fit_context", "WITH z AS (SELECT 1)" + DEMO_EDGES + """
, u AS (SELECT e.test_id, rank, train_id, length(b.text) + sum(d.n_chars) OVER (PARTITION BY e.test_id ORDER BY rank) AS used
 FROM e JOIN documents d ON d.doc_id = train_id JOIN benchmark b ON b.item_id = e.test_id)
SELECT test_id, rank, train_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 4000""")
def _(t):
    edges, _ = demo_edges(t)
    edges = edges.join(t.documents.select(F.col("doc_id").alias("train_id"), F.col("n_chars").alias("n_tokens")), "train_id")
    bare = t.benchmark.select(F.col("item_id").alias("test_id"), F.length("text").alias("base_tokens"))
    return P.fit_context(edges, 4000, bare).select("test_id", "rank", "train_id", "used")


@query("b12_to_chat", ITEMS + """
SELECT item_id, 'user=' || category || '|user=' || difficulty || '|assistant=' || gold AS chat FROM ev_items""")
def _(t):
    rows = P.to_chat(t.ev_items, ["category", "difficulty"], "gold")
    flat = F.array_join(F.transform("chat", lambda m: F.concat_ws("=", m["role"], m["content"])), "|")
    return rows.select("item_id", flat.alias("chat"))


@query("b12_rounds_to_chat", """
WITH r AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS u, list(text ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, i, u[i] AS ut, a[i] AS ans FROM r, range(1, 20) g(i) WHERE i <= greatest(coalesce(len(u), 0), coalesce(len(a), 0)))
SELECT conv_id, string_agg(concat_ws('|', 'user=' || ut, 'assistant=' || ans), '|' ORDER BY i) AS chat FROM x GROUP BY conv_id""")
def _(t):
    texts = lambda role: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda s: s["text"]
    )
    rows = t.conversations.groupBy("conv_id").agg(texts("user").alias("u"), texts("assistant").alias("a"))
    chat = P.rounds_to_chat(rows, "u", "a")
    flat = F.array_join(F.transform("chat", lambda m: F.concat_ws("=", m["role"], m["content"])), "|")
    return chat.select("conv_id", flat.alias("chat"))


HISTORY = """
WITH h AS (SELECT a.conv_id, a.turn, a.text AS gold, string_agg(b.role || '=' || b.text, '|' ORDER BY b.turn) AS history
 FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn, a.text)
SELECT conv_id, turn, coalesce(history, '') AS history, gold FROM h"""


def flat_history(df):
    flat = F.array_join(F.transform("history", lambda m: F.concat_ws("=", m["role"], m["content"])), "|")
    return df.select("conv_id", "turn", flat.alias("history"), "gold")


@query("b13_chat_histories_every", HISTORY)
def _(t):
    return flat_history(P.chat_histories(t.conversations))


@query("b13_chat_histories_last", HISTORY + " WHERE (conv_id, turn) IN (SELECT conv_id, max(turn) FROM conversations WHERE role = 'assistant' GROUP BY conv_id)")
def _(t):
    return flat_history(P.chat_histories(t.conversations, "last"))


@query("b13_fed_back_histories", """
WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS before FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'assistant' AND before > 0 THEN 'model answer after ' || CAST(before AS VARCHAR) || ' turns' ELSE text END AS text, text AS gold FROM c""")
def _(t):
    def answer(prompts):
        said = F.concat(F.lit("model answer after "), F.size("history"), F.lit(" turns"))
        return prompts.select("conv_id", said.alias("text"))

    turns = range((t.conversations.agg(F.max("turn")).first()[0] or 0) + 1)
    return P.fed_back_histories(t.conversations, answer, turns).select("conv_id", "turn", "text", "gold")


ROUNDS = """
WITH f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations WHERE role <> 'system'),
r AS (SELECT conv_id, CAST((turn - t0) // 2 + 1 AS BIGINT) AS round, max(text) FILTER (role = 'user') AS "user", max(text) FILTER (role = 'assistant') AS assistant FROM f GROUP BY 1, 2)
"""


@query("b14_pack_rounds", ROUNDS + "SELECT * FROM r")
def _(t):
    return P.pack_rounds(t.conversations)


@query("b14_unpack_rounds", ROUNDS + "SELECT conv_id, " + ", ".join(
    f'max("user") FILTER (round = {i}) AS "{i}_user", max(assistant) FILTER (round = {i}) AS "{i}_assistant"' for i in range(1, 5)
) + " FROM r GROUP BY conv_id")
def _(t):
    return P.unpack_rounds(P.pack_rounds(t.conversations), 4)


@query("b14_listed_rounds", ROUNDS + """SELECT conv_id, string_agg(round || ': ' || coalesce("user", '-') || ' / ' || coalesce(assistant, '-'), chr(10) ORDER BY round) AS rounds, count(*) AS n
FROM r GROUP BY conv_id""")
def _(t):
    said = lambda r: F.concat(r["round"].cast("string"), F.lit(": "), F.coalesce(r["user"], F.lit("-")), F.lit(" / "), F.coalesce(r["assistant"], F.lit("-")))
    rows = P.listed_rounds(P.pack_rounds(t.conversations))
    return rows.select("conv_id", F.array_join(F.transform("rounds", said), "\n").alias("rounds"), F.size("rounds").cast("bigint").alias("n"))


@query("b15_render_chat", """
SELECT conv_id, '<s>' || string_agg(CASE role WHEN 'user' THEN '[U]' || text || '[/U]' WHEN 'assistant' THEN '[A]' || text || '[/A]' ELSE '[S]' || text || '[/S]' END, '' ORDER BY turn) || '</s>' AS prompt
FROM conversations GROUP BY conv_id""")
def _(t):
    roles = {"user": ("[U]", "[/U]"), "assistant": ("[A]", "[/A]"), "system": ("[S]", "[/S]")}
    return P.render_chat(t.conversations, roles, "<s>", "</s>")


@query("b15_render_chat_generate", """
WITH p AS (SELECT *, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END AS k FROM conversations),
l AS (SELECT *, lag(k, 1, -1) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM p),
s AS (SELECT *, max(turn) FILTER (k >= 0 AND (b < 0 OR k <= b)) OVER (PARTITION BY conv_id) AS cut FROM l),
x AS (SELECT conv_id, turn, cut, CASE WHEN turn > cut AND k < 0 OR turn > cut AND k = 1 THEN '' ELSE
 CASE WHEN b = 0 AND k <= 0 THEN '[A][/A]' ELSE '' END || CASE WHEN k = 1 AND b <> 0 THEN '[U][/U]' ELSE '' END ||
 CASE WHEN k = 0 THEN '[U]' || text || '[/U]' WHEN k < 0 THEN '[S]' || text || '[/S]' WHEN turn = cut THEN '' ELSE '[A]' || text || '[/A]' END END AS piece FROM s)
SELECT conv_id, '<s>' || string_agg(piece, '' ORDER BY turn) || CASE WHEN max(cut) IS NULL THEN '</s>' ELSE '[A]' END AS prompt FROM x GROUP BY conv_id""")
def _(t):
    roles = [P.RoleMarks("user", "[U]", "[/U]"), P.RoleMarks("assistant", "[A]", "[/A]", generate=True)]
    return P.render_rounds(t.conversations, roles, [P.RoleMarks("system", "[S]", "[/S]")], begin="<s>", end="</s>", generate=True)


def with_options(t):
    return t.part.select(
        F.col("p_partkey").alias("item_id"),
        F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("options"),
        F.substr(F.lit("ABCD"), (F.col("p_partkey") % 4).cast("int") + 1, F.lit(1)).alias("gold"),
    )


def OPTIONS_SQL(patterns: list[str], condition: str = "true") -> str:
    listed = ", ".join(f"('{p}')" for p in patterns)
    places = " || '|' || ".join(f"o[strpos('ABCD', substr(p, {i}, 1))]" for i in (1, 2, 3, 4))
    return f"""WITH i AS (SELECT p_partkey AS item_id, [p_name, p_brand, p_type, CAST(p_size AS VARCHAR)] AS o, substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1) AS g FROM part)
SELECT item_id, p AS circular_pattern, {places} AS options, substr('ABCD', strpos(p, g), 1) AS gold FROM i, (VALUES {listed}) x(p) WHERE {condition}"""


def flat_options(df):
    return df.withColumn("options", F.array_join("options", "|")).select("item_id", "circular_pattern", "options", "gold")


@query("b16_rotate_options", OPTIONS_SQL(P.circular_patterns("ABCD")))
def _(t):
    return flat_options(P.rotate_options(with_options(t)))


@query("b16_permute_options", OPTIONS_SQL(P.all_patterns("ABCD")))
def _(t):
    return flat_options(P.rotate_options(with_options(t), "all"))


@query("b17_cycle_options", OPTIONS_SQL(P.circular_patterns("ABCD"), "p = ['ABCD', 'BCDA', 'CDAB', 'DABC'][CAST(item_id % 4 AS INT) + 1]"))
def _(t):
    return flat_options(P.cycle_options(with_options(t), "item_id"))


@query("b17_shuffle_options", OPTIONS_SQL(P.all_patterns("ABCD"), f"p = {D.SHUFFLED}"))
def _(t):
    return flat_options(P.shuffle_options(with_options(t), 11, "item_id"))


@query("b18_balance_positions", D.BALANCED)
def _(t):
    pairs = t.ev_items.select("item_id", F.lit("x").alias("model_a"), F.lit("y").alias("model_b"))
    return P.balance_positions(pairs, 5, "item_id")


@query("b19_order_answers_double", with_tables("ev_battles") + """
SELECT item_id, pos, model_a, model_b, false AS swapped FROM ev_battles UNION ALL SELECT item_id, pos, model_b, model_a, true FROM ev_battles""")
def _(t):
    return P.order_answers(t.ev_battles.select("item_id", "pos", "model_a", "model_b"), "double")


@query("b19_order_answers_random", D.ORDERED_AT_RANDOM)
def _(t):
    return P.order_answers(t.ev_battles.select("item_id", "pos", "model_a", "model_b"), "random", seed=3)


@query("b20_fan_out_prompts", PREDS + """
SELECT model, item_id, pos, k AS prompt_no, CASE k WHEN 0 THEN 'Is this right? ' || prediction ELSE 'Grade: ' || prediction || '!' END AS prompt FROM ev_predictions, (VALUES (0), (1)) x(k)""")
def _(t):
    rows = t.ev_predictions.select("model", "item_id", "pos", "prediction").withColumn(
        "judge_prompts", F.array(F.lit("Is this right? {prediction}"), F.lit("Grade: {prediction}!"))
    )
    return P.fan_out_prompts(rows).drop("prediction")


@query("b21_stack_original", """
SELECT doc_id, source AS premise, lang AS hypothesis, 'perturbed' AS variant FROM documents WHERE lang <> 'en'
UNION ALL SELECT doc_id, 'was ' || source, lang, 'original' FROM documents WHERE lang <> 'en'""")
def _(t):
    rows = t.documents.select(
        "doc_id", F.col("source").alias("premise"), F.col("lang").alias("hypothesis"),
        F.when(F.col("lang") != "en", F.concat(F.lit("was "), "source")).alias("original_premise"),
        F.lit(None).cast("string").alias("original_hypothesis"),
    )
    return P.stack_original(rows, ["premise", "hypothesis"])


@query("b22_dedup_items", "SELECT text, min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang FROM documents GROUP BY text")
def _(t):
    return P.dedup_items(t.documents.select("doc_id", "text", "lang"), "text", "doc_id")


@query("b23_line_pairs", """
WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, 'forward' AS direction, x AS question, y AS answer FROM p UNION ALL SELECT conv_id, turn, 'reverse', y, x FROM p""")
def _(t):
    return P.line_pairs(t.conversations, ["conv_id"], "turn", "text")


@query("b24_move_boundary_spaces", """
WITH x AS (SELECT doc_id, lang || repeat(' ', CAST(doc_id % 4 AS INT)) AS c, source AS k FROM documents)
SELECT doc_id, rtrim(c) AS context, substr(c, length(rtrim(c)) + 1) || k AS continuation FROM x""")
def _(t):
    context = F.concat("lang", F.repeat(F.lit(" "), (F.col("doc_id") % 4).cast("int")))
    left, right = P.move_boundary_spaces(context, F.col("source"))
    return t.documents.select("doc_id", left.alias("context"), right.alias("continuation"))


@query("b25_length_features", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS INT) AS cn_chars, CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS INT) AS en_words FROM documents""")
def _(t):
    return t.documents.select("doc_id", *[c.alias(k) for k, c in P.length_features(F.col("text")).items()])


def count_sql(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(x, '{pattern}')) AS INT)"


@query("b26_style_features", "WITH s AS (SELECT doc_id, text, regexp_replace(text, '(?s)```.*?```', '', 'g') AS x FROM documents) SELECT doc_id, " + ", ".join(
    f"{count_sql(p)} AS {k}" for k, p in P.STYLE_MARKS.items()
) + r", CAST(len(regexp_extract_all(x, '\S+')) AS INT) AS tokens FROM s")
def _(t):
    return t.documents.select("doc_id", *[c.alias(k) for k, c in P.style_features(F.col("text")).items()])


@query("b27_filter_dates", """
SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def _(t):
    return P.filter_dates(t.events, "ts", "2024-01-05T00:00:00", "2024-01-20T12:00:00").select("event_id", "user_id")


@query("h15_stop_and_clean", """
SELECT doc_id, split_part(split_part(text, ' de ', 1), chr(10), 1) AS text FROM documents""")
def _(t):
    return t.documents.select("doc_id", P.stop_and_clean(F.col("text"), [" de ", "\n"]).alias("text"))
