"""Evaluation tables derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

# name -> (tables it reads, SQL text)
DERIVED: dict[str, tuple[list[str], str]] = {
    "ev_items": (
        ["orders"],
        """SELECT o_orderkey AS item_id, substr('ABCD', CAST(o_orderkey % 4 AS INT) + 1, 1) AS gold,
        o_orderpriority AS category, o_orderstatus AS difficulty, o_totalprice AS price, o_orderdate AS day
        FROM {orders}""",
    ),
    "ev_predictions": (
        ["lineitem"],
        """SELECT 'm' || CAST(l_suppkey % 5 AS STRING) AS model, l_orderkey AS item_id,
        l_linenumber * 1000000000000 + l_partkey AS pos,
        substr('ABCD', CAST(l_partkey % 4 AS INT) + 1, 1) AS answer,
        CASE l_linenumber % 4
          WHEN 0 THEN 'Let me think. The answer is (' || substr('ABCD', CAST(l_partkey % 4 AS INT) + 1, 1) || ').'
          WHEN 1 THEN 'Cost ' || CAST(l_partkey AS STRING) || '. So the answer is ' || substr('ABCD', CAST(l_partkey % 4 AS INT) + 1, 1) || '. done'
          WHEN 2 THEN substr('ABCD', CAST(l_partkey % 4 AS INT) + 1, 1)
          ELSE 'i am not sure, sorry' END AS prediction
        FROM {lineitem}""",
    ),
    "ev_scored": (
        ["ev_predictions", "ev_items"],
        """SELECT p.model, p.item_id, p.pos, p.answer, p.prediction, i.gold, i.category, i.difficulty
        FROM {ev_predictions} p JOIN {ev_items} i ON p.item_id = i.item_id""",
    ),
    "ev_results": (
        ["ev_scored"],
        """SELECT model, category AS dataset, 'accuracy' AS metric,
        avg(CASE WHEN answer = gold THEN 100e0 ELSE 0e0 END) AS score
        FROM {ev_scored} GROUP BY model, category
        UNION ALL
        SELECT model, category AS dataset, 'items' AS metric, CAST(count(DISTINCT item_id) AS DOUBLE) AS score
        FROM {ev_scored} GROUP BY model, category""",
    ),
    "ev_label_scores": (
        ["lineitem"],
        """SELECT l_orderkey AS item_id, CAST(l_linenumber % 4 AS INT) AS label_pos,
        substr('ABCD', CAST(l_linenumber % 4 AS INT) + 1, 1) AS label,
        min((l_partkey % 997) / 100e0) AS nll, min(l_quantity) AS n_tokens,
        min(l_quantity * 4 + l_linenumber) AS n_bytes
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber % 4""",
    ),
    "ev_token_losses": (
        ["events"],
        "SELECT user_id AS seq_id, event_id AS pos, value AS loss, event_type FROM {events}",
    ),
    "ev_judgements": (
        ["lineitem"],
        """SELECT 'j' || CAST(l_linenumber % 3 AS STRING) AS judge, l_orderkey AS item_id,
        'm' || CAST(l_suppkey % 7 AS STRING) AS model_a, 'm' || CAST(l_partkey % 7 AS STRING) AS model_b,
        l_returnflag || '-' || l_linestatus AS capability, l_returnflag AS area,
        CAST(l_quantity AS INT) AS difficulty_points,
        CASE (l_orderkey + l_linenumber + l_partkey) % 6
          WHEN 0 THEN 'My verdict: [[A>>B]]' WHEN 1 THEN 'My verdict: [[A>B]]' WHEN 2 THEN 'My verdict: [[A=B]]'
          WHEN 3 THEN 'My verdict: [[B>A]]' WHEN 4 THEN 'My verdict: [[B>>A]]' ELSE 'no verdict here' END AS verdict_text
        FROM {lineitem} WHERE l_suppkey % 7 <> l_partkey % 7""",
    ),
    "ev_battles": (
        ["lineitem"],
        """SELECT 'm' || CAST(l_suppkey % 7 AS STRING) AS model_a, 'm' || CAST(l_partkey % 7 AS STRING) AS model_b,
        l_orderkey AS item_id, l_linenumber * 1000000000000 + l_partkey AS pos,
        CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN 'model_a' WHEN 1 THEN 'model_b' ELSE 'tie' END AS winner,
        l_quantity AS len_a, l_tax * 100 + l_linenumber AS len_b, l_returnflag AS category
        FROM {lineitem} WHERE l_suppkey % 7 <> l_partkey % 7""",
    ),
    "ev_text_pairs": (
        ["conversations"],
        """SELECT a.conv_id * 1000 + a.turn AS pair_id, a.role AS model, a.text AS prediction, b.text AS reference
        FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
    ),
    "ev_url_pairs": (
        ["pages"],
        """SELECT a.page_id AS pair_id, CASE WHEN a.page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model,
        a.url AS prediction, b.url AS reference
        FROM {pages} a JOIN {pages} b ON a.page_id = b.page_id + 1""",
    ),
}


def with_tables(*names: str) -> str:
    """``WITH ...`` text that defines the derived tables (and what they need) for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in DERIVED:
            return
        for need in DERIVED[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        needs, text = DERIVED[name]
        for need in needs:
            text = text.replace("{" + need + "}", need)
        parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts) + "\n"
