"""DuckDB SQL for the queries, written against the tables and not derived from the Spark plans.

Rules on text are chains of common table expressions. RE2 knows no look-around and no Unicode white space, which
the test texts don't need.
"""

from __future__ import annotations

import unicodedata

from corpusloom.functions import patterns as P
from corpusloom.queries import _LANGS, PHRASES, SEED


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    return pattern.replace("(?!:?File:|Image:)", "").replace("{{", r"\{\{").replace("}}", r"\}\}")


def _sub(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, {_quoted(_re2(pattern))}, {_quoted(to)}, 'g')"


def _sub_two(text: str, pattern: str, to: str) -> str:
    """The first two matches: texts between matches, joined by the replacement twice and by the matches after that."""
    p, r = _quoted(_re2(pattern)), _quoted(to)
    parts, found = f"string_split_regex({text}, {p})", f"regexp_extract_all({text}, {p}, 0)"
    return (
        f"({parts}[1] || coalesce({r} || {parts}[2], '') || coalesce({r} || {parts}[3], '') || "
        f"array_to_string(list_transform(range(4, len({parts}) + 1), lambda i: {found}[i - 1] || {parts}[i]), ''))"
    )


def _chain(source: str, rules: list[tuple], keep: str = "doc_id") -> str:
    """source: a query with keep and text. rules: (pattern, replacement[, limited])."""
    steps = [f"r0 AS ({source})"]
    for i, rule in enumerate(rules, 1):
        made = _sub_two("text", rule[0], rule[1]) if rule[2:] == (True,) else _sub("text", rule[0], rule[1])
        steps.append(f"r{i} AS MATERIALIZED (SELECT {keep}, {made} AS text FROM r{i - 1})")
    return f"WITH {', '.join(steps)} SELECT {keep}, text FROM r{len(rules)}"


def _until_stable(source: str, rules: list[tuple], finish: str = "text") -> str:
    step = "text"
    for pattern, to in rules:
        step = _sub(step, pattern, to)
    return f"""WITH RECURSIVE f(doc_id, text, n) AS ({source} UNION ALL SELECT doc_id, {step}, n + 1 FROM f WHERE {step} <> text)
        SELECT doc_id, {finish.replace("text", "arg_max(text, n)")} AS text FROM f GROUP BY doc_id"""


# ---------------------------------------------------------------- vectors

_SIDES = """q AS (SELECT vec_id AS q_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 4 = 0),
    t AS (SELECT vec_id AS t_id, label AS label_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 4 <> 0)"""
_CENTROIDS = """c AS (SELECT label_id, pos, avg(x) AS x FROM (SELECT label_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM t) GROUP BY ALL),
    t2 AS (SELECT label_id AS t_id, label_id, list(x ORDER BY pos) AS v FROM c GROUP BY label_id)"""


def _near(k: int, side: str = "t") -> str:
    return f"""d AS (SELECT q_id, t_id, label_id, greatest(1 - list_dot_product(q.v, {side}.v), 0) AS d FROM q CROSS JOIN {side}),
    n AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, t_id) AS rank FROM d QUALIFY rank <= {k}),
    w AS (SELECT *, CASE WHEN min(d) OVER (PARTITION BY q_id) = 0 THEN (d = 0)::INT::DOUBLE ELSE 1 / d END AS w FROM n),
    votes AS (SELECT q_id, label_id, sum(w) AS w FROM w GROUP BY ALL)"""


def _predicted(k: int) -> str:
    return f"""{_SIDES}, {_near(k)}, p AS (SELECT q_id, label_id AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round(w, 9) DESC, label_id) = 1),
    pl AS (SELECT q_id, label, prediction FROM p JOIN q USING (q_id))"""


def _scored(k: int, centred: bool = False) -> str:
    near = f"{_CENTROIDS}, {_near(k, 't2')}" if centred else _near(k)
    return f"""{_SIDES}, {near}, labels_ AS (SELECT DISTINCT label_id FROM t),
    s AS (SELECT q.q_id, l.label_id, coalesce(v.w, 0) / sum(coalesce(v.w, 0)) OVER (PARTITION BY q.q_id) AS p,
                 (l.label_id IN (q.label, (q.label + 1) % 10))::INT AS rel
          FROM q CROSS JOIN labels_ l LEFT JOIN votes v ON v.q_id = q.q_id AND v.label_id = l.label_id)"""


_NDCG = """, r AS (SELECT q_id, round(p, 12) AS p, rel, row_number() OVER (PARTITION BY q_id ORDER BY round(p, 12) DESC, label_id) AS k, row_number() OVER (PARTITION BY q_id ORDER BY rel DESC) AS ki FROM s),
    g AS (SELECT q_id, avg(rel) * sum(CASE WHEN k <= 5 THEN 1 / log2(k + 1) ELSE 0 END) AS g FROM r GROUP BY q_id, p),
    i AS (SELECT q_id, sum(CASE WHEN ki <= 5 THEN rel / log2(ki + 1) ELSE 0 END) AS best FROM r GROUP BY q_id)
    SELECT q_id, round(CASE WHEN any_value(best) > 0 THEN sum(g) / any_value(best) ELSE 0 END, 6) AS ndcg FROM g JOIN i USING (q_id) GROUP BY q_id"""

_ACCURACY = f"""SELECT 1 AS k, (WITH {_predicted(1)} SELECT round(avg((label = prediction)::INT), 6) FROM pl) AS accuracy
    UNION ALL SELECT 3, (WITH {_predicted(3)} SELECT round(avg((label = prediction)::INT), 6) FROM pl)"""

_SAMPLER = f"""turns AS (SELECT range::INT AS iteration FROM range(1, 4)), classes AS (SELECT DISTINCT label FROM embeddings),
    quota AS (SELECT iteration, label, CASE WHEN row_number() OVER (PARTITION BY iteration ORDER BY md5(label || '-' || iteration || '-{SEED}'), label) <= 7 THEN 4 ELSE 3 END AS quota FROM turns CROSS JOIN classes),
    drawn AS (SELECT iteration, vec_id AS id, label, embedding::DOUBLE[] AS v, quota FROM embeddings JOIN quota USING (label)
              QUALIFY row_number() OVER (PARTITION BY iteration, label ORDER BY md5(vec_id || '-' || iteration || '-{SEED}'), vec_id) <= quota)"""

# ---------------------------------------------------------------- labels

_R = """CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN (doc_id % 17 + 1) || '.' || (doc_id % 9) || '.1'
    ELSE (doc_id % 17 + 1) || '.' || (doc_id % 9) || '.1,' || (doc_id % 5 + 1) || '.b.2' END"""


def _labels(part: str) -> str:
    made = f"list_transform(string_split(r, ','), lambda x: {part})"
    return f"CASE WHEN r <> '' AND ({made})[1] <> ({made})[-1] THEN array_to_string({made}, '|') END"


def _words(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> ''))"


def _category(words: str, edges: list[int]) -> str:
    return f"CASE WHEN {words} <= 0 THEN NULL {' '.join(f'WHEN {words} <= {e} THEN {k}' for k, e in enumerate(edges, 1))} ELSE {len(edges) + 1} END"


_GOALS = f"SELECT doc_id, source AS goal, coalesce(lang, '') AS section, {_words('text')} AS words FROM documents"
_TARGETS = f"SELECT doc_id, goal, '1.' || (doc_id % 7) AS target, CASE WHEN doc_id % 2 = 0 THEN 'Targets' ELSE section END AS section FROM ({_GOALS})"
_PRIO = "CASE section " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(_LANGS)) + " END"
_GOAL_SAMPLE = "SELECT * FROM ({source}) WHERE section IN ('" + "','".join(_LANGS) + f"') QUALIFY row_number() OVER (PARTITION BY goal ORDER BY {_PRIO}, doc_id) <= 14"
_TARGET_SAMPLE = f"SELECT * FROM ({_TARGETS}) WHERE section = 'Targets' QUALIFY row_number() OVER (PARTITION BY target ORDER BY doc_id) <= 6"


def split_of(rows: str, fine: list[int], coarse: list[int]) -> str:
    """rows: a query with doc_id, source and words."""
    return f"""WITH g AS (SELECT *, {_category("words", fine)} AS cat3, {_category("words", coarse)} AS cat2, count(*) OVER (PARTITION BY source) AS n FROM ({rows})),
    v AS (SELECT *, ceil(n * 0.25) AS n_val FROM g),
    c3 AS (SELECT source, min(c) >= 2 AND count(*) <= any_value(n_val) AND count(*) <= any_value(n - n_val) AS ok FROM (SELECT source, cat3, count(*) AS c, any_value(n_val) AS n_val, any_value(n) AS n FROM v GROUP BY ALL) GROUP BY source),
    c2 AS (SELECT source, min(c) >= 2 AND count(*) <= any_value(n_val) AND count(*) <= any_value(n - n_val) AS ok FROM (SELECT source, cat2, count(*) AS c, any_value(n_val) AS n_val, any_value(n) AS n FROM v GROUP BY ALL) GROUP BY source),
    s AS (SELECT v.*, CASE WHEN c3.ok THEN 'cat3:' || coalesce(cat3::VARCHAR, '') WHEN c2.ok THEN 'cat2:' || coalesce(cat2::VARCHAR, '') ELSE 'all' END AS stratum FROM v JOIN c3 USING (source) JOIN c2 USING (source)),
    z AS (SELECT source, stratum, count(*) AS size, any_value(n) AS n, any_value(n_val) AS n_val FROM s GROUP BY ALL),
    f AS (SELECT *, floor(size * n_val / n) AS low, round(size * n_val / n - floor(size * n_val / n), 9) AS rest FROM z),
    q AS (SELECT source, stratum, low + (row_number() OVER (PARTITION BY source ORDER BY rest DESC, stratum) <= n_val - sum(low) OVER (PARTITION BY source))::INT AS quota FROM f)
    SELECT doc_id, source AS goal, row_number() OVER (PARTITION BY source, stratum ORDER BY md5(doc_id || '-{SEED}'), doc_id) <= quota AS validation FROM s JOIN q USING (source, stratum)"""


_SPLIT = split_of(f"SELECT doc_id, source, {_words('text')} AS words FROM documents", [100, 400], [200])

# ---------------------------------------------------------------- text


def _phrased(kind: str) -> str:
    some = PHRASES[kind]
    return f"SELECT doc_id, [{', '.join(map(_quoted, some))}][doc_id % {len(some)} + 1] || text AS text FROM documents"


def _numbers(source: str) -> str:
    first = _chain(source, P.NUMBER_RULES_ONCE)
    step = "text"
    for pattern, to, limited in P.NUMBER_RULES:
        step = _sub_two(step, pattern, to) if limited else _sub(step, pattern, to)
    links = "now"
    for pattern, to, _ in P.NUMBER_RULES_LINKS:
        links = _sub(links, pattern, to)
    return f"""WITH RECURSIVE f(doc_id, text, n, more) AS (SELECT doc_id, text, 0, true FROM ({first}) UNION ALL
        SELECT doc_id, new, n + 1, new <> text FROM (SELECT doc_id, text, n, CASE WHEN doc_id % 2 = 0 THEN {links} ELSE now END AS new FROM (SELECT *, {step} AS now FROM f WHERE more)))
        SELECT doc_id, arg_max(text, n) AS text FROM f GROUP BY doc_id"""


def _sentences(source: str, keep: str = "doc_id") -> str:
    """keep, pos (from 0) and sentence. source: a query with keep and text."""
    protect = _chain(source, P.ABBREVIATIONS, keep)
    back = "x"
    for pattern, to in P.ABBREVIATIONS_BACK:
        back = _sub(back, pattern, to)
    pieces = f"list_filter(string_split_regex(text, {_quoted(P.SEPARATORS)}), lambda x: x <> '')"
    return f"SELECT {keep}, (pos - 1)::INT AS pos, {back} AS sentence FROM (SELECT {keep}, unnest({pieces}) AS x, unnest(range(1, len({pieces}) + 1)) AS pos FROM ({protect}))"


def _joined(one: str, two: str) -> str:
    a, b = f"trim({one}, ' \t\n')", f"trim({two}, ' \t\n')"
    made = f"""CASE WHEN regexp_matches({b}, '^[^A-Z].') THEN {a} || ' ' || {b} WHEN regexp_matches({a}, '^.+[:;?!]\\s*$') THEN {a} || ' ' || {b}
        WHEN {a} = '' THEN {b} ELSE {a} || '. ' || {b} END"""
    for pattern, to in ((r"(\.\s?){2,}", ". "), (r"\s{2,}", " "), (r"^\.\s+", "")):
        made = _sub(made, pattern, to)
    return f"trim({made}, ' \t\n')"


def _packed(sentences: str, key: str, low: int, high: int) -> str:
    """key, part (from 0) and excerpt. sentences: a query with key, pos and sentence. A row of f is what is gathered after i sentences, and what they finished."""
    total = "(f.n + s.words)"
    before = f"({total} > {high} AND (f.n >= {low} OR (f.n > 0 AND abs({total} - {high}) >= abs({low} - f.n))))"
    both, done = _joined("f.text", "s.p"), _joined("f.text", _quoted(""))
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS i, sentence AS p, {_words("sentence")} AS words FROM ({sentences})
            WHERE sentence <> '' AND NOT regexp_matches(trim(sentence, ' \t\n'), '^\\.+$') AND NOT regexp_matches(trim(sentence, ' \t\n'), '^Category:.+$')),
        f(key, i, text, n, excerpt) AS (SELECT DISTINCT key, 0::BIGINT, '', 0::BIGINT, NULL::VARCHAR FROM s UNION ALL
            SELECT f.key, s.i, CASE WHEN {before} THEN s.p WHEN {total} > {high} THEN '' ELSE {both} END, CASE WHEN {before} THEN s.words WHEN {total} > {high} THEN 0 ELSE {total} END,
                CASE WHEN {before} THEN {done} WHEN {total} > {high} THEN {both} END FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1),
        e AS (SELECT key, i, excerpt FROM f WHERE excerpt IS NOT NULL UNION ALL SELECT key, i + 1, {done} FROM (SELECT key, max(i) AS i, arg_max(text, i) AS text FROM f GROUP BY key) f WHERE text <> '')
        SELECT key, (row_number() OVER (PARTITION BY key ORDER BY i) - 1)::INT AS part, excerpt FROM e"""


_NUMBERED = f"""WITH l AS (SELECT doc_id, source AS goal, (doc_id % 17) || '.' || (doc_id % 3) AS target, {_words("text")} AS words, min(doc_id) OVER (PARTITION BY source, doc_id % 17, doc_id % 3, coalesce(lang, '')) AS begun FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY goal, target ORDER BY begun, doc_id) AS rn FROM l),
    k AS (SELECT * FROM r WHERE rn = 1 OR words BETWEEN 5 AND 415)
    SELECT goal || '_' || target || '_' || (row_number() OVER (PARTITION BY goal, target ORDER BY begun, doc_id) - 1) AS id, goal, target, doc_id, begun FROM k"""

_GENERAL = """WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS line_no FROM
      (SELECT doc_id, 'before' || chr(10) || '==== Goal ' || (doc_id % 17 + 1) || ': name ====' || chr(10) || text || chr(10) || ' ' || chr(10) || '=== Closing ===' || chr(10) || 'after' || chr(10) || '==== Goal 1: x' || chr(10) || 'last' AS t FROM documents)),
    m AS (SELECT *, CASE WHEN line LIKE '==== Goal %' THEN substr(line, 11, strpos(line, ':') - 11) WHEN regexp_matches(line, '^===[\\sA-Z]') THEN '' END AS mark FROM l),
    g AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS goal FROM m)
    SELECT doc_id, line_no, goal, 'https://en.wikipedia.org/wiki/The_title' AS source_url, trim(line, ' \t') AS text FROM g WHERE mark IS NULL AND coalesce(goal, '') <> '' AND trim(line, ' \t') <> ''"""

_PLAIN = [(chr(c), d[0]) for c in range(0xC0, 0x180) if len(d := [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) == 1 and d[0] != chr(c)]
_PIECES = "SELECT conv_id || '-' || turn AS id, text FROM conversations"
_TFIDF = f"""s AS ({_PIECES}), nn AS (SELECT count(*) AS n FROM s),
    k AS (SELECT id, unnest(regexp_extract_all(translate(lower(text), '{"".join(a for a, _ in _PLAIN)}', '{"".join(b for _, b in _PLAIN)}'), '[\\pL\\pN_]{{2,}}')) AS term FROM s),
    c AS (SELECT id, term, count(*) AS tf FROM k WHERE term NOT IN ('the', 'and', 'of') GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 10),
    x AS (SELECT id, term, df, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM c JOIN f USING (term) CROSS JOIN nn),
    w AS (SELECT id, term, df, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x)"""

NOISE = f"""WITH {_TFIDF}, m AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b USING (term) GROUP BY ALL HAVING sum(a.w * b.w) >= 0.7 - 1e-9),
    core AS (SELECT a FROM m GROUP BY a HAVING count(*) >= 10)
    SELECT id FROM s WHERE id NOT IN (SELECT a FROM m WHERE b IN (FROM core))"""

ORACLE_SQL: dict[str, str] = {
    "nearest_neighbours": f"WITH {_SIDES}, {_near(3)} SELECT q_id, t_id, round(d, 6) AS d, rank FROM n",
    "knn1_predictions": f"WITH {_predicted(1)} SELECT q_id, label, prediction FROM pl",
    "knn3_predictions": f"WITH {_predicted(3)} SELECT q_id, label, prediction FROM pl",
    "knn_accuracy": _ACCURACY,
    "label_correction_accuracy": f"WITH {_predicted(3)} SELECT round(avg((prediction IN (label, (label + 3) % 10))::INT), 6) AS accuracy FROM pl",
    "knn20_probabilities": f"WITH {_scored(20)} SELECT q_id, label_id, round(p, 6) AS p FROM s",
    "ndcg5": f"WITH {_scored(20)} {_NDCG}",
    "centroid_vectors": f"WITH {_SIDES}, {_CENTROIDS} SELECT label_id, pos::INT AS pos, round(x, 6) AS x FROM c",
    "centroid_ndcg5": f"WITH {_scored(10, True)} {_NDCG}",
    "result_rows": f"SELECT k, 'HASHING' AS encoder, {SEED}::BIGINT AS random_seed, 0 AS checkpoint, 14 AS goal_count, 6 AS target_count, NULL::DOUBLE AS validation, accuracy AS test FROM ({_ACCURACY})",
    "batch_sampler": f"WITH {_SAMPLER} SELECT iteration, id, label FROM drawn",
    "triplet_loss": f"""WITH {_SAMPLER}, p AS (SELECT a.iteration, a.id, max(CASE WHEN a.label = b.label AND a.id <> b.id THEN greatest(1 - list_dot_product(a.v, b.v), 0) END) AS far,
        min(CASE WHEN a.label <> b.label THEN greatest(1 - list_dot_product(a.v, b.v), 0) END) AS near FROM drawn a JOIN drawn b USING (iteration) GROUP BY ALL)
        SELECT iteration, round(avg(greatest(0, coalesce(far, 0) - coalesce(near, 0) + 0.4)), 6) AS loss FROM p GROUP BY iteration""",
    "label_dictionary": "SELECT source AS label, (row_number() OVER (ORDER BY min(doc_id), source) - 1)::INT AS label_id FROM documents WHERE source <> '' GROUP BY source",
    "multi_label_parse": f"SELECT doc_id, r, {_labels('regexp_extract(x, ' + _quoted('^[0-9]+') + ')')} AS goals, {_labels('regexp_extract(x, ' + _quoted('^[0-9]+[.][0-9a-z]+') + ')')} AS targets, {_labels('x')} AS links FROM (SELECT doc_id, {_R} AS r FROM documents)",
    "indicator_ids": """SELECT p_partkey, id, string_split(id, '.')[1] AS goal, string_split(id, '.')[1] || '.' || string_split(id, '.')[2] AS target FROM
        (SELECT p_partkey, (p_partkey % 17 + 1) || '.' || CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE (p_partkey % 9 + 1)::VARCHAR END || '.' || (p_size % 4 + 1) AS id FROM part)""",
    "word_buckets": f"SELECT id, words::INT AS words, {_category('words', [10, 20])} AS cat3, {_category('words', [15])} AS cat2 FROM (SELECT 'b' || item_id AS id, {_words('text')} AS words FROM benchmark UNION ALL SELECT conv_id || '-' || turn, {_words('text')} FROM conversations)",
    "external_texts": """SELECT p_partkey, p_brand AS goal, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ',' || trim(p_type) ELSE '' END AS repeats,
        CASE WHEN d = '' THEN n ELSE d END || CASE WHEN n LIKE '%.' THEN '' ELSE '.' END AS definition,
        n || CASE WHEN n LIKE '%.' THEN ' ' ELSE '. ' END || CASE WHEN d = '' THEN '' WHEN d LIKE '%.' THEN d ELSE d || '.' END AS both FROM
        (SELECT *, regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS n, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Of ' || regexp_replace(trim(p_type), '\\s+', ' ', 'g') END AS d FROM part)""",
    "stratified_split": _SPLIT,
    "goal_sample": f"SELECT doc_id, goal, section FROM ({_GOAL_SAMPLE.format(source=_GOALS)})",
    "target_sample": f"SELECT doc_id, target FROM ({_TARGET_SAMPLE})",
    "training_sample": f"{_GOAL_SAMPLE.format(source=_TARGETS)} UNION {_TARGET_SAMPLE}",
    "html_unwrap": _chain("SELECT page_id, html AS text FROM pages", [(P.BREAK, ""), *((p, "") for p in P.SUBSCRIPTS), *((p, "") for p in P.REFERENCES), (P.PAIRED_TAG, r"\1"), (P.COMMENT, ""), ("&nbsp;", " ")], keep="page_id"),
    "template_fixpoint": _until_stable("SELECT doc_id, '{{a {{b|' || doc_id || '}} c {{d {{e}} }} }}x{{}}y' || text || ' {{z}}', 0 FROM documents", [(P.TEMPLATE, "")]),
    "link_fixpoint": _until_stable("SELECT doc_id, '[[a|b ' || doc_id || ']] [[c [[d|e]] f]]  and [[g|h|i]] ' || text, 0 FROM documents", [(P.PIPED_LINK, r"\2"), (P.PLAIN_LINK, r"\1")], _sub("text", P.SPACES, " ")),
    "url_and_file_markup": _chain(
        "SELECT doc_id, '[[File:x' || doc_id || '.png|thumb|see [[y]] there]]''''''bold'''''' [https://e.org/a some label] [http://e.org] ' || text AS text FROM documents",
        [*((p, "") for p in P.FILE_LINKS), (P.LABELLED_URL, r"\1"), (P.BARE_URL, ""), (P.QUOTES, "")],
    ),
    "mask_indicators": _chain(_phrased("indicator"), P.INDICATOR_RULES),
    "mask_lists": _chain(_phrased("list"), P.LIST_RULES),
    "mask_numbers": _numbers(_phrased("number")),
    "mask_phrases": _chain(_phrased("phrase"), P.PHRASE_RULES),
    "sentence_split": _sentences("SELECT doc_id, 'e.g. this, i.e. that (etc.) of U.S. kind.Then? more;; ' || text AS text FROM documents"),
    "packed_sentences": f"SELECT key AS doc_id, part AS pos, excerpt FROM ({_packed(_sentences('SELECT doc_id, text FROM documents'), 'doc_id', 20, 40)})",
    "join_fragments": f"SELECT conv_id, turn, {_joined('text', 'role')} AS low, {_joined('text', 'upper(role[1]) || lower(role[2:])')} AS high, {_joined('text', _quoted(''))} AS done FROM conversations",
    "excerpt_ids": f"SELECT id, goal, target, doc_id FROM ({_NUMBERED})",
    "general_article": _GENERAL,
    "tfidf_weights": f"WITH {_TFIDF} SELECT id, term, df, round(w, 6) AS w FROM w",
    "boilerplate_noise": NOISE,
    "encoded_benchmark": """WITH w AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark),
        h AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w),
        v AS (SELECT item_id, (h % 256)::INT AS pos, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY ALL)
        SELECT item_id, 256 AS dim, pos, round((x / sqrt(sum(x * x) OVER (PARTITION BY item_id)))::FLOAT::DOUBLE, 4) AS x FROM v QUALIFY x <> 0""",
}
