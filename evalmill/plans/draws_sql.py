"""SQL of the queries that draw: the same MD5 draws as in ``functions.draws``."""

from __future__ import annotations

from evalmill.functions.draws import sql_bits, sql_distinct, sql_drawn_order, sql_uniform
from evalmill.operators import synthetic as Y
from evalmill.operators.sequences import MASK_ID
from evalmill.plans.fixtures import with_tables


def words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def token_ids(column: str) -> str:
    return f"list_transform({words(column)}, lambda w: CAST({sql_bits(0, 'w')} % {MASK_ID} AS INT))"


SAMPLE_EXACT = f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_bits(7, 'o_orderkey')}, o_orderkey) AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM r WHERE k <= floor(0.3e0 * n)"""

SHUFFLED = f"array_to_string(list_transform(list_sort(list_transform(['A', 'B', 'C', 'D'], lambda c: {{'h': {sql_bits(11, 'item_id', 'c')}, 'c': c}})), lambda s: s.c), '')"

BALANCED = with_tables("ev_items") + f"""
, r AS (SELECT item_id, row_number() OVER (ORDER BY {sql_bits(5, 'item_id')}, item_id) AS k, count(*) OVER () AS n FROM ev_items),
s AS (SELECT item_id, k <= n // 2 + n % 2 AS swapped FROM r)
SELECT item_id, CASE WHEN swapped THEN 'y' ELSE 'x' END AS model_a, CASE WHEN swapped THEN 'x' ELSE 'y' END AS model_b, swapped FROM s"""

ORDERED_AT_RANDOM = with_tables("ev_battles") + f"""
, s AS (SELECT *, {sql_bits(3, 'item_id', 'model_a', 'model_b')} % 2 = 1 AS swapped FROM ev_battles)
SELECT item_id, pos, CASE WHEN swapped THEN model_b ELSE model_a END AS model_a, CASE WHEN swapped THEN model_a ELSE model_b END AS model_b, swapped FROM s"""

RANDOM_DEMOS = f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents), n AS (SELECT count(*) AS n FROM documents),
l AS (SELECT o_orderkey AS test_id, {sql_distinct('n', 4, 43, 'o_orderkey')} AS l FROM orders, n),
p AS (SELECT test_id, unnest(l) AS idx, generate_subscripts(l, 1) AS k FROM l)
SELECT test_id, CAST(k AS INT) AS "rank", doc_id AS train_id FROM p JOIN d USING (idx)"""

MASKED = f"""
ids AS (SELECT doc_id AS seq_id, {token_ids('text')} AS input_ids FROM documents)"""

MASK_TOKENS = f"""
WITH {MASKED}, p AS (SELECT *, 0.999e0 * {sql_uniform(0, 'seq_id')} + 0.001e0 AS p_mask FROM ids),
m AS (SELECT *, list_transform(input_ids, lambda x, i: {sql_uniform(1, 'seq_id', 'i - 1')} < p_mask) AS masked FROM p)
SELECT *, list_transform(input_ids, lambda x, i: CASE WHEN masked[i] THEN {MASK_ID} ELSE x END) AS noisy FROM m"""

TRUNCATED = f"""
WITH {MASKED}
SELECT seq_id, CASE WHEN {sql_uniform(3, 'seq_id')} < 0.01e0 AND len(input_ids) > 0 THEN input_ids[1:CAST(floor({sql_uniform(4, 'seq_id')} * len(input_ids)) AS INT) + 1]
 ELSE input_ids END AS input_ids FROM ids"""

SFT_ROWS = with_tables("ev_text_pairs") + f"""
, a AS (SELECT pair_id AS seq_id, {token_ids('reference')} AS q, {token_ids('prediction')} AS r FROM ev_text_pairs),
b AS (SELECT seq_id, q || r || list_transform(range(greatest(512 - len(q) - len(r), 0)), lambda x: 126081) AS input_ids, CAST(len(q) AS INT) AS prompt_length,
 0.999e0 * {sql_uniform(0, 'seq_id')} + 0.001e0 AS p_mask FROM a),
c AS (SELECT *, CAST(len(input_ids) - prompt_length AS INT) AS answer_length,
 list_transform(input_ids, lambda x, i: {sql_uniform(1, 'seq_id', 'i - 1')} < p_mask AND i > prompt_length) AS masked FROM b)
SELECT *, list_transform(input_ids, lambda x, i: CASE WHEN masked[i] THEN {MASK_ID} ELSE x END) AS noisy,
 list_transform(masked, lambda m: CASE WHEN m THEN 1 / (p_mask * answer_length) ELSE 0e0 END) AS weight FROM c"""

STRATIFIED = with_tables("ev_text_pairs") + f"""
, a AS (SELECT pair_id AS item_id, CAST(len({words('reference')}) AS INT) AS prompt_length, CAST(len({words('prediction')}) AS INT) AS target_length FROM ev_text_pairs),
b AS (SELECT *, floor({sql_uniform(0, 'item_id')} * target_length) + 1 AS first FROM a WHERE target_length > 0),
c AS (SELECT item_id, prompt_length, target_length, CAST(x AS INT) AS batch,
 CAST((CAST(round_even(first + x * (target_length / 8e0), 0) AS INT) - 1) % target_length + 1 AS INT) AS masked FROM b, range(8) t(x)),
d AS (SELECT *, list_sort(list_transform(range(target_length), lambda i: {{'h': {sql_bits(1, 'item_id', 'batch', 'i')}, 'i': i}}))[1:masked] AS l FROM c)
SELECT item_id, prompt_length, target_length, batch, masked, list_sort(list_transform(l, lambda s: CAST(s.i + prompt_length AS INT))) AS positions,
 masked / CAST(target_length AS DOUBLE) AS ratio FROM d"""

# --- synthetic sets


def haystacks(length: int, repeats: int) -> str:
    return f"""
hd AS (SELECT doc_id, {words('text')} AS k FROM documents),
hh AS (SELECT r AS repeat, doc_id, k[1:{length}] AS k, {sql_bits(0, 'r', 'doc_id')} AS h FROM hd, range({repeats}) t(r) WHERE len(k) > 0),
ho AS (SELECT *, coalesce(sum(len(k)) OVER (PARTITION BY repeat ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM hh),
hay AS (SELECT CAST(repeat AS INT) AS repeat, flatten(list(k ORDER BY b))[1:{length}] AS hay FROM ho WHERE b < {length} GROUP BY repeat),
per AS (SELECT o_orderstatus AS st, max(o_totalprice) AS price FROM orders GROUP BY 1),
ne AS (SELECT hay.*, string_split('the dearest order of status ' || st || ' costs ' || CAST(price AS VARCHAR), ' ') AS needle,
 'What does the dearest order of status ' || st || ' cost?' AS question, CAST(price AS VARCHAR) AS keyword FROM hay JOIN per ON st = ['F', 'O', 'P'][repeat % 3 + 1])"""


def insert(tokens: str, piece: str, place: str) -> str:
    return f"({tokens})[1:{place}] || {piece} || ({tokens})[{place} + 1:]"


NEEDLE = f"""
WITH {haystacks(2000, 3)},
g AS (SELECT *, hay[1:CAST(greatest(n - 50 - len(needle), 0) AS INT)] AS h FROM ne, (VALUES (500), (1000), (2000)) a(n), (VALUES (0), (25), (50), (75), (100)) b(d)),
c AS (SELECT *, CAST(floor(len(h) * d / 100) AS INT) AS p FROM g)
SELECT repeat, n AS length, d AS depth, array_to_string({insert('h', 'needle', 'p')}, ' ') || chr(10) || chr(10) || 'Based on the text above, now please answer: ' || question AS prompt,
 array_to_string(needle, ' ') || '*' || keyword AS answer FROM c"""

MULTI_NEEDLE = f"""
WITH {haystacks(1000, 3)},
a AS (SELECT *, len(hay) AS total, {insert('hay', 'needle', 'p')} AS t1, p + len(needle) + CAST(floor(len(hay) * 10 / 100) AS INT) AS p1 FROM (SELECT *, CAST(floor(len(hay) * 20 / 100) AS INT) AS p FROM ne)),
b AS (SELECT *, {insert('t1', "['second', 'needle']", 'q1')} AS t2, q1 + 2 + CAST(floor(total * 10 / 100) AS INT) AS p2 FROM (SELECT *, least(p1, len(t1)) AS q1 FROM a)),
c AS (SELECT *, {insert('t2', "['third', 'needle']", 'q2')} AS t3 FROM (SELECT *, least(p2, len(t2)) AS q2 FROM b))
SELECT repeat, array_to_string(t3, ' ') AS context, keyword FROM c"""

PARALLEL_NEEDLES = f"""
WITH {haystacks(1000, 3)},
a AS (SELECT *, CAST(floor(len(hay) * 10 / 100) AS INT) AS p, CAST(floor(len(hay) * 90 / 100) AS INT) AS q FROM ne)
SELECT repeat, array_to_string(hay[1:p] || needle || hay[p + 1:q] || ['second', 'needle'] || hay[q + 1:], ' ') AS context, keyword || '*second#10*90' AS answer FROM a"""


def chosen(values: list[str], place: str) -> str:
    return f"[{', '.join(text(v) for v in values)}][CAST({place} AS INT) + 1]"


def fragment() -> str:
    said = chosen(Y.RELATION_TEXTS, f"floor({sql_uniform(2, 'item_id', 'i')} * {len(Y.RELATION_TEXTS)})")
    relation = chosen(Y.RELATIONS, f"floor({sql_uniform(1, 'item_id', 'i')} * {len(Y.RELATIONS)})")
    return f"replace(replace(replace({said}, '{{a}}', chain[i + 1]), '{{b}}', chain[i + 2]), '{{r}}', {relation})"


KINSHIP = f"""
WITH names AS (SELECT list(n_name ORDER BY n_name) AS names, count(*) AS n FROM nation),
c AS (SELECT o_orderkey AS item_id, list_transform({sql_distinct('n', 6, 0, 'o_orderkey')}, lambda i: names[i + 1]) AS chain FROM orders, names),
f AS (SELECT *, list_transform(range(5), lambda i: {fragment()}) AS fs FROM c)
SELECT item_id, array_to_string({sql_drawn_order('fs', 3, 'item_id')}, '') || chr(10) || 'Who is the eldest relative that ''' || chain[6] || ''' can trace back to?' AS prompt,
 chain[1] AS answer FROM f"""


def scattered(lines: str, pieces: str, places: str) -> str:
    """List of lines with piece i put before line places[i] (counted from 0)."""
    own = f"list_transform({lines}, lambda x, i: {{'p': i - 1, 's': 1, 'x': x}})"
    put = f"list_transform({pieces}, lambda x, i: {{'p': ({places})[i], 's': 0, 'x': x}})"
    return f"list_transform(list_sort({own} || {put}), lambda s: s.x)"


def key_value(decoys: bool) -> str:
    key = lambda *k: f"'key-' || hex({sql_bits(0, 'item_id', *k)} % {1 << 40})"
    value = lambda *k: f"CAST({sql_bits(1, 'item_id', *k)} % 9000000 + 1000000 AS VARCHAR)"
    head, middle, end = (text(x) for x in Y._pieces(Y.NEEDLE_TEXT))
    say = lambda k, v: f"{head} || {k} || {middle} || {v} || {end}"
    lines = say(key("i + 1000000"), value("i + 1000000", "0")) if decoys else "l[i % greatest(len(l), 1) + 1]"
    return rf"""
WITH a AS (SELECT item_id, list_filter(string_split_regex(text, '[.\n]\s*'), lambda s: s <> '') AS l FROM benchmark),
b AS (SELECT *, flatten(list_transform(range(4), lambda i: list_transform(range(2), lambda j: {say(key('i'), value('i', 'j'))}))) AS ns,
 list_transform(range(60), lambda i: {lines}) AS ls, list_sort({sql_distinct('60', 8, 3, 'item_id')}) AS ps, {sql_distinct('4', 2, 4, 'item_id')} AS qs FROM a),
c AS (SELECT *, {sql_drawn_order('ns', 2, 'item_id')} AS nd FROM b)
SELECT item_id, array_to_string({scattered('ls', 'nd', 'ps')}, chr(10)) || chr(10) || 'What are all the special magic numbers for ' ||
 array_to_string(list_transform(qs, lambda i: {key('i')}), ' and ') || '?' AS prompt,
 flatten(list_transform(qs, lambda i: list_transform(range(2), lambda j: {value('i', 'j')}))) AS answers FROM c"""


def chain_name(c: int, h: int) -> str:
    return f"'V' || hex({sql_bits(0, 'item_id', str(c * 1000 + h))} % {1 << 36})"


def chain_lines(c: int) -> str:
    first = f"'VAR ' || {chain_name(c, 0)} || ' = ' || CAST({sql_bits(1, 'item_id', str(c))} % 89999 + 10000 AS VARCHAR)"
    return f"[{', '.join([first] + [f"'VAR ' || {chain_name(c, h + 1)} || ' = VAR ' || {chain_name(c, h)}" for h in range(4)])}]"


VARIABLE_CHAINS = f"""
WITH a AS (SELECT item_id, list_transform(range(40), lambda i: 'The grass is green.') AS l, {chain_lines(0)} AS c0, {chain_lines(1)} AS c1,
 list_sort({sql_distinct('40', 5, 2, 'item_id')}) AS p0, list_sort({sql_distinct('45', 5, 3, 'item_id')}) AS p1 FROM benchmark),
b AS (SELECT *, {scattered('l', 'c0', 'p0')} AS l0 FROM a)
SELECT item_id, array_to_string({scattered('l0', 'c1', 'p1')}, ' ') || chr(10) || 'Find all variables that are assigned the value ' ||
 CAST({sql_bits(1, 'item_id', '0')} % 89999 + 10000 AS VARCHAR) || ' in the text above.' AS prompt, [{', '.join(chain_name(0, h) for h in range(5))}] AS answers FROM b"""


def drawn_words(n: int) -> str:
    return f"""
w AS (SELECT DISTINCT unnest({words('text')}) AS word FROM documents),
v AS (SELECT word, row_number() OVER (ORDER BY {sql_bits(0, 'word')}) - 1 AS idx FROM w), total AS (SELECT count(*) AS n FROM v),
dl AS (SELECT item_id, {sql_distinct('n', n, 0, 'item_id')} AS l FROM benchmark, total),
du AS (SELECT item_id, unnest(l) AS idx, generate_subscripts(l, 1) AS k FROM dl),
dw AS (SELECT item_id, list(word ORDER BY k) AS ws FROM du JOIN v USING (idx) GROUP BY item_id)"""


COMMON_WORDS = f"""
WITH {drawn_words(40)},
c AS (SELECT *, flatten(list_transform(ws, lambda w, i: list_transform(range(CASE WHEN i <= 10 THEN 30 ELSE 3 END), lambda j: w))) AS cs FROM dw),
o AS (SELECT *, {sql_drawn_order('cs', 5, 'item_id')} AS os FROM c)
SELECT item_id, array_to_string(list_transform(os, lambda w, i: CAST(i AS VARCHAR) || '. ' || w), ' ') || chr(10) || 'What are the 10 most common words in the above list?' AS prompt,
 ws[1:10] AS answers FROM o"""


def frequent(n_vocab: int = 50, n_words: int = 300, alpha: float = 2.0) -> str:
    zeta = sum(i**-alpha for i in range(1, 200_000))
    counts = [int(n_words * r**-alpha / zeta) for r in range(1, n_vocab + 1)]
    return f"""
WITH {drawn_words(n_vocab - 1)},
c AS (SELECT *, flatten(list_transform(['...'] || ws, lambda w, i: list_transform(range({counts}[i]), lambda j: w))) AS cs FROM dw)
SELECT item_id, array_to_string({sql_drawn_order('cs', 5, 'item_id')}, ' ') AS prompt, ws[1:3] AS answers FROM c"""


FREQUENT_WORDS = frequent()

# the places drawn here are far more than 4,000 tokens need
DISTRACTORS = f"""
WITH d AS (SELECT doc_id, source, text, len({words('text')}) AS n FROM documents),
ix AS (SELECT doc_id, n, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS total FROM d),
q AS (SELECT source, min(doc_id) AS item_id FROM d GROUP BY source),
r AS (SELECT item_id, {sql_bits(0, 'item_id', 'j')} % (SELECT count(*) FROM d) AS idx, j FROM q, range(3000) t(j)),
f AS (SELECT item_id, idx, min(j) AS j FROM r GROUP BY 1, 2),
s AS (SELECT f.item_id, ix.doc_id, g.n + sum(ix.n) OVER (PARTITION BY f.item_id ORDER BY j) AS used FROM f JOIN ix USING (idx) JOIN d g ON g.doc_id = f.item_id WHERE ix.doc_id <> f.item_id),
k AS (SELECT item_id, item_id AS doc_id FROM q UNION ALL SELECT item_id, doc_id FROM s WHERE used <= 4000),
o AS (SELECT k.item_id, k.doc_id, d.text, row_number() OVER (PARTITION BY k.item_id ORDER BY {sql_bits(1, 'k.item_id', 'k.doc_id')}, k.doc_id) AS p FROM k JOIN d USING (doc_id)),
c AS (SELECT item_id, string_agg('Document ' || CAST(p AS VARCHAR) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY p) AS context, list(doc_id ORDER BY p) AS doc_ids FROM o GROUP BY item_id)
SELECT item_id, context || chr(10) || chr(10) || 'Based on the text above, now please answer: Which source is ' || source || '?' AS prompt, source AS answer, doc_ids FROM c JOIN q USING (item_id)"""
