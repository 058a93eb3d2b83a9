"""DuckDB SQL for the queries over files, plans and chains of rules."""

from __future__ import annotations

from corpusloom import oracles as O
from corpusloom.functions import patterns as P
from corpusloom.plan_queries import ARTICLE_LIST, LINKED, TAGGED
from corpusloom.queries import PHRASES

# ---------------------------------------------------------------- evaluation and learning


def _accuracy(k: int) -> str:
    return f"(WITH {O._predicted(k)} SELECT round(avg((prediction = label OR (q_id % 3 = 0 AND prediction = (label + 3) % 10))::INT), 6) FROM pl)"


def _mean_ndcg(k: int, centred: bool = False) -> str:
    """Over the rows with two labels, that is every third."""
    scored = O._scored(k, centred).replace("(q.label + 1) % 10", "(q.label + 3) % 10").removesuffix(")") + " WHERE q.q_id % 3 = 0)"
    return f"(SELECT round(avg(ndcg), 6) FROM (WITH {scored} {O._NDCG.replace('round(CASE', '(CASE').replace('END, 6)', 'END)')}))"


_LEARNED = """SELECT *, (row_number() OVER (ORDER BY goal, target, -item_id) - 1)::INT AS pos FROM
    (SELECT item_id, (item_id % 17 + 1)::INT AS goal, CASE WHEN item_id % 3 = 0 THEN '' ELSE (item_id % 17 + 1) || '.' || (item_id % 4) END AS target FROM benchmark)"""

# ---------------------------------------------------------------- chains of rules

_TAG_RULES = [(P.BREAK, ""), *((p, "") for p in P.SUBSCRIPTS), *((p, "") for p in P.REFERENCES), (P.PAIRED_TAG, r"\1"), (P.COMMENT, ""), ("&nbsp;", " ")]


def _stripped() -> str:
    tags = O._chain(f"SELECT doc_id, {O._quoted(TAGGED + LINKED)} || text AS text FROM documents", _TAG_RULES)
    templates = O._until_stable(f"SELECT doc_id, text, 0 FROM ({tags})", [(P.TEMPLATE, "")])
    links = O._chain(f"SELECT doc_id, text FROM ({templates})", [*((p, "") for p in P.FILE_LINKS), (P.LABELLED_URL, r"\1"), (P.BARE_URL, ""), (P.QUOTES, "")])
    return O._until_stable(f"SELECT doc_id, text, 0 FROM ({links})", [(P.PIPED_LINK, r"\2"), (P.PLAIN_LINK, r"\1")], O._sub("text", P.SPACES, " "))


def _masked() -> str:
    leads = " || ".join(f"[{', '.join(map(O._quoted, some))}][doc_id % {len(some)} + 1]" for some in PHRASES.values())
    indicators = O._chain(f"SELECT doc_id, {leads} || text AS text FROM documents", P.INDICATOR_RULES)
    numbers = O._numbers(f"SELECT doc_id, text FROM ({indicators})")
    lists = O._chain(f"SELECT doc_id, text FROM ({numbers})", P.LIST_RULES)
    return O._chain(f"SELECT doc_id, text FROM ({lists})", P.PHRASE_RULES)


#: Lines of an article's parts in order. A line of kind `head` counts only where a list is open; what the line after a
#: section's end opens is never told.
_ARTICLE = f"""WITH RECURSIVE t AS (SELECT doc_id, string_split(text || CASE WHEN doc_id % 3 = 0 THEN {O._quoted(ARTICLE_LIST)} ELSE '' END, chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, trim(unnest(lines), ' \t') AS line, unnest(range(len(lines))) AS i FROM t),
    parts AS (SELECT doc_id, part, i, line, part = 0 AS lead, false AS head FROM l, (VALUES (0), (1)) v(part) WHERE line <> ''
        UNION ALL SELECT doc_id, 0, 1000000, '== Background ==', true, true FROM t UNION ALL SELECT doc_id, 1, 1000000, 'of these:', false, false FROM t),
    s AS MATERIALIZED (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id, part ORDER BY i) AS i, line, head,
        CASE WHEN lead THEN line LIKE '*%' ELSE line LIKE '%*' END AS item, NOT lead AND line LIKE '%*' AS opens, line LIKE '%:' AS colon, replace(line, '*', '') || ';; ' AS entry FROM parts),
    f(doc_id, part, i, open, done) AS (SELECT DISTINCT doc_id, part, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR[] FROM s UNION ALL
        SELECT f.doc_id, f.part, s.i,
            CASE WHEN f.open IS NOT NULL AND item THEN f.open || entry WHEN f.open IS NULL AND opens AND NOT colon THEN entry WHEN colon THEN line END,
            CASE WHEN f.open IS NULL AND (head OR colon OR opens) THEN [] WHEN f.open IS NOT NULL AND item THEN [] WHEN f.open IS NULL THEN [line] WHEN colon THEN [f.open] ELSE [f.open, line] END
        FROM f JOIN s ON s.doc_id = f.doc_id AND s.part = f.part AND s.i = f.i + 1),
    told AS (SELECT doc_id, part, i, unnest(done) AS text, unnest(range(len(done))) AS j FROM f WHERE len(done) > 0
        UNION ALL SELECT doc_id, 2, i, x, 0 FROM t, (VALUES (1, 'of these:one ;; two ;;'), (2, 'end'), (3, 'such as:'), (4, '* a'), (5, '* b'), (6, 'then')) v(i, x)
        UNION ALL SELECT doc_id, 3, i, x, 0 FROM t, (VALUES (1, 'By 2030'), (2, 'such as: a;;  b;;'), (3, 'then')) v(i, x))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, i, j) - 1 AS emit_ord, '3' AS goal, CASE WHEN part = 3 THEN '1.2' ELSE '' END AS target,
        ['Lead section', 'Background', 'Tools', 'Targets'][part + 1] AS section, trim(text, ' \t') AS text FROM told"""


def _excerpts() -> str:
    sentences = O._sentences("SELECT conv_id || '-' || turn AS id, text FROM conversations", "id")
    pieces = f"SELECT id || '-' || pos AS id, sentence AS text FROM ({sentences})"
    kept = f"SELECT id, pos, sentence FROM ({sentences}) WHERE id || '-' || pos IN ({O.NOISE.replace(O._PIECES, pieces)})"
    return f"""WITH c AS (SELECT conv_id || '-' || turn AS key, conv_id * 1000000 + turn AS place, (conv_id % 2)::VARCHAR AS goal,
            CASE WHEN turn % 5 = 4 THEN 'x.y' ELSE (conv_id % 4) || '.' || (turn % 3) END AS target, role || ' said' AS section FROM conversations),
        e AS (SELECT c.*, part, excerpt FROM ({O._packed(kept, "id", 5, 12)}) JOIN c USING (key)),
        one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY goal, target, section, lower(excerpt) ORDER BY place, part) = 1),
        r AS (SELECT *, min(place) OVER (PARTITION BY goal, target, section) AS begun, {O._words("excerpt")} AS words FROM one),
        n AS (SELECT *, row_number() OVER (PARTITION BY goal, target ORDER BY begun, place, part) AS rn FROM r),
        k AS (SELECT *, goal || '_' || target || '_' || (row_number() OVER (PARTITION BY goal, target ORDER BY begun, place, part) - 1) AS id FROM n WHERE words BETWEEN 1 AND 16 OR rn = 1)
        SELECT id, goal, target, section, excerpt FROM k WHERE target <> 'x.y'"""


# ---------------------------------------------------------------- files

_INDICATOR = f"""SELECT *, {O._words("text")} AS words FROM (SELECT p_partkey, (p_partkey % 17 + 1) || '.' || (p_partkey % 9 + 1) || '.' || p_partkey AS id, CASE WHEN p_size > 25 THEN '1.1.1,2.2.2' ELSE '' END AS repeats,
    (p_partkey % 17 + 1)::VARCHAR AS goal, (p_partkey % 17 + 1) || '.' || (p_partkey % 9 + 1) AS target,
    p_name || ', "' || p_type || '"' || chr(10) || repeat('more ', p_size // 4) || p_brand AS text FROM part WHERE p_partkey % 10 <> 0)"""


def _all_joined(text: str) -> str:
    """The one or two sentences of a text joined again."""
    first, second = f"string_split({text}, '. ')[1]", f"string_split({text}, '. ')[2]"
    one = O._joined(O._quoted(""), first)
    return f"CASE WHEN {text} = '' THEN '' WHEN {second} IS NULL THEN {one} ELSE {O._joined(one, second)} END"


_EXTERNAL = f"""WITH p AS (SELECT p_partkey, regexp_replace(trim(p_name), '\\s+', ' ', 'g') || CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE '' END AS n,
        CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Of ' || regexp_replace(trim(p_type), '\\s+', ' ', 'g') || CASE WHEN p_partkey % 2 = 0 THEN '. Or ' || p_brand ELSE '' END END AS d FROM part),
    q AS (SELECT *, CASE WHEN d = '' THEN n ELSE d END || CASE WHEN n LIKE '%.' THEN '' ELSE '.' END AS dn FROM p),
    r AS (SELECT *, {_all_joined("dn")} AS one, {_all_joined("d")} AS two FROM q), goals AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN '1,2' ELSE '' END AS g FROM r)
    SELECT p_partkey::VARCHAR AS id, 0 AS option, g AS repeats, '1' AS goal, '1.2' AS target, n AS text FROM goals
    UNION ALL SELECT p_partkey::VARCHAR, 1, CASE WHEN p_partkey % 5 = 0 THEN '1.2,2.b' ELSE '' END, '1', '1.2', one FROM goals
    UNION ALL SELECT p_partkey::VARCHAR, 2, g, '1', '1.2', n || CASE WHEN n LIKE '%.' THEN ' ' ELSE '. ' END || CASE WHEN d = '' THEN '' WHEN two LIKE '%.' THEN two ELSE two || '.' END FROM goals"""

def _branches() -> str:
    sets, parts = {**dict.fromkeys(["IND-TITLE-AGENDA"], "i"), **dict.fromkeys(["SDG-TITLE-WIKI"], "g"), **dict.fromkeys(["IND-DESCR-EUSDG", "IND-DESCR-WDISDG", "IND-DESCR-URBAN", "IND-DESCR-REGIONS"], "e")}, []
    served = {
        "IND-TITLE-AGENDA": "MC-IND-SDG MC-IND-TRG ML-IND-SDG", "SDG-TITLE-WIKI": "ML-SDG-SDG", "IND-DESCR-EUSDG": "MC-IND-SDG ML-IND-SDG", "IND-DESCR-WDISDG": "MC-IND-SDG MC-IND-TRG",
        "IND-DESCR-URBAN": "MC-IND-SDG MC-IND-TRG ML-IND-SDG", "IND-DESCR-REGIONS": "MC-IND-SDG MC-IND-TRG",
    }
    columns = {"MC-IND-SDG": ("goal", "goal"), "MC-IND-TRG": ("target", "target"), "ML-IND-SDG": ("goal", "repeats"), "ML-SDG-SDG": ("goal", "links")}
    for name, source in sets.items():
        for task in served[name].split():
            train, test = columns[task]
            parts.append(f"SELECT '{name}' AS dataset, '{task}' AS task, side, '{train}' AS train_label, '{test}' AS test_label, id, {test} AS label, text FROM {source}")
    split = O.split_of(f"SELECT id AS doc_id, goal AS source, words FROM ({_INDICATOR})", [10, 20], [15]).replace(str(O.SEED), "42")
    return f"""WITH i AS MATERIALIZED (SELECT id, repeats, i.goal, target, text, CASE WHEN validation THEN 'validation' ELSE 'test' END AS side FROM ({_INDICATOR}) i JOIN ({split}) s ON i.id = s.doc_id),
        g AS (SELECT (n_nationkey % 16 + 1)::VARCHAR AS id, array_to_string(list_sort(list(n_regionkey::VARCHAR)), ',') AS links, min(n_name) AS text, 'test' AS side FROM nation GROUP BY n_nationkey % 16),
        e AS (SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 2 = 0 THEN '1,2' ELSE '' END AS repeats, '1' AS goal, '1.2' AS target, regexp_replace(trim(p_name), '\\s+', ' ', 'g') || CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE '' END AS text, 'test' AS side FROM part)
        {" UNION ALL ".join(parts)}"""


def _sampled() -> str:
    """Lines of the two exports in order, masked, split, filtered, packed, numbered and drawn. Odd numbers, as the masks' SQL takes even ones for a section of their own."""
    lines = """SELECT conv_id, turn, conv_id % 2 AS single, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM conversations
        UNION ALL SELECT conv_id, turn, 1, 'About it', 0 FROM conversations WHERE conv_id % 2 = 1 AND turn > 0"""
    masked = O._chain(f"SELECT doc_id, {O._sub('line', P.SPACES, ' ')} AS text FROM para", P.INDICATOR_RULES)
    for rules in (None, P.LIST_RULES, P.PHRASE_RULES):
        masked = O._chain(f"SELECT doc_id, text FROM ({masked})", rules) if rules else O._numbers(f"SELECT doc_id, text FROM ({masked})")
    sentences = O._sentences("SELECT doc_id, text FROM msk")
    kept = f"SELECT doc_id, pos, sentence FROM sent WHERE id IN ({O.NOISE.replace(O._PIECES, 'SELECT id, sentence AS text FROM sent')})"
    order = "begun, place, part"
    return f"""WITH l AS ({lines}), para AS MATERIALIZED (SELECT (single * 1000000000000 + conv_id * 1000000 + turn * 1000 + n) * 2 + 1 AS doc_id, conv_id, (conv_id % 17 + 1)::VARCHAR AS goal,
            CASE WHEN single = 1 AND turn > 0 THEN (conv_id % 17 + 1) || '.' || turn ELSE '' END AS target, CASE WHEN single = 0 THEN 'General' WHEN turn = 0 THEN 'Lead section' ELSE 'Targets' END AS section, trim(line, ' \t') AS line FROM l WHERE trim(line, ' \t') <> ''),
        msk AS MATERIALIZED ({masked}), sent AS MATERIALIZED (SELECT doc_id, pos, sentence, doc_id || '-' || pos AS id FROM ({sentences})), pk AS MATERIALIZED ({O._packed(kept, "doc_id", 20, 40)}),
        e AS (SELECT para.*, para.doc_id AS place, part, excerpt FROM pk JOIN para ON pk.key = para.doc_id),
        one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY goal, target, section, conv_id, lower(excerpt) ORDER BY place, part) = 1),
        r AS (SELECT *, min(place) OVER (PARTITION BY goal, target, section, conv_id) AS begun, {O._words("excerpt")} AS words FROM one),
        f AS (SELECT *, row_number() OVER (PARTITION BY goal, target ORDER BY {order}) AS rn FROM r),
        k AS (SELECT *, goal || '_' || target || '_' || (row_number() OVER (PARTITION BY goal, target ORDER BY {order}) - 1) AS id FROM f WHERE words BETWEEN 5 AND 55 OR (target <> '' AND rn = 1)),
        a AS (SELECT * FROM k WHERE section <> 'Targets' QUALIFY row_number() OVER (PARTITION BY goal ORDER BY section <> 'General', {order}) <= 14),
        b AS (SELECT * FROM k WHERE section = 'Targets' QUALIFY row_number() OVER (PARTITION BY target ORDER BY {order}) <= 6)
        SELECT id, goal, target, section, excerpt FROM a UNION ALL SELECT id, goal, target, section, excerpt FROM b"""


ORACLE_SQL: dict[str, str] = {
    "evaluated_classes": f"SELECT 1 AS k, {_accuracy(1)} AS accuracy UNION ALL SELECT 3, {_accuracy(3)}",
    "evaluated_lists": f"SELECT 20 AS k, {_mean_ndcg(20)} AS ndcg UNION ALL SELECT 40, {_mean_ndcg(40)}",
    "evaluated_centroids": f"SELECT 10 AS k, {_mean_ndcg(10, True)} AS ndcg",
    "learner_goals": f"SELECT 'e' || item_id AS id, goal::VARCHAR AS goal, goal - 1 AS y, pos FROM ({_LEARNED})",
    "learner_targets": f"""WITH l AS ({_LEARNED}), y AS (SELECT target, (row_number() OVER (ORDER BY min(pos)) - 1)::INT AS y FROM l GROUP BY target)
        SELECT 'e' || item_id AS id, goal::VARCHAR AS goal, y, pos FROM l JOIN y USING (target)""",
    "learner_ranges": f"""SELECT goal::VARCHAR AS goal, min(pos) AS "start", max(pos) + 1 AS "end" FROM ({_LEARNED}) GROUP BY goal""",
    "label_encoding": """WITH d AS (SELECT doc_id, source FROM documents WHERE doc_id % 9 <> 0), n AS (SELECT source, (row_number() OVER (ORDER BY min(doc_id), source) - 1)::INT AS label_id FROM d GROUP BY source)
        SELECT doc_id, label_id FROM d JOIN n USING (source)""",
    "label_relevance": """WITH n AS (SELECT source AS label, (row_number() OVER (ORDER BY min(doc_id), source) - 1)::INT AS label_id FROM documents GROUP BY source)
        SELECT doc_id, label_id, (label IN (source, 'src' || (doc_id % 3)))::INT AS rel FROM documents CROSS JOIN n WHERE doc_id % 5 <> 0""",
    "tag_markup": O._chain(f"SELECT doc_id, {O._quoted(TAGGED)} || text AS text FROM documents", _TAG_RULES),
    "stripped_article": _stripped(),
    "masked_paragraphs": _masked(),
    "specific_article": _ARTICLE,
    "conversation_excerpts": _excerpts(),
    "indicator_csv": f"SELECT id, repeats, goal, target, text, words::INT AS word_count, {O._category('words', [10, 20])} AS word_cat_3, {O._category('words', [15])} AS word_cat_2 FROM ({_INDICATOR})",
    "indicator_split": f"""SELECT id, i.goal, target, CASE WHEN validation THEN 'validation' ELSE 'test' END AS side
        FROM ({_INDICATOR}) i JOIN ({O.split_of(f"SELECT id AS doc_id, goal AS source, words FROM ({_INDICATOR})", [10, 20], [15])}) s ON i.id = s.doc_id""",
    "goal_csv": """SELECT (n_nationkey % 16 + 1)::VARCHAR AS id, array_to_string(list_sort(list(n_regionkey::VARCHAR)), ',') AS links, (n_nationkey % 16 + 1)::VARCHAR AS goal,
        array_to_string(list_sort(list(n_name)), ', ') AS text FROM nation GROUP BY n_nationkey % 16""",
    "external_csv": _EXTERNAL,
    "wiki_xml": """SELECT (doc_id % 2)::INT AS file_ord, doc_id % 2 = 0 AS is_general, 'Page ' || doc_id AS title, '1' AS revision_id, '2020-01-01' AS revision_timestamp, '| ' || text || ' <&> |' AS text FROM documents""",
    "result_csv": f"SELECT r.*, task FROM ({O.ORACLE_SQL['result_rows']}) r, (VALUES ('MC-IND-SDG'), ('ML-IND-SDG'), ('ML-IND-SDG')) t(task)",
    "evaluation_branches": _branches(),
    "allowed_counts": """SELECT task, goal_count, target_count, (task, goal_count, target_count) IN (
            ('MC-IND-SDG', 14, 6), ('MC-IND-SDG', 14, 17), ('MC-IND-SDG', 22, 6), ('MC-IND-SDG', 22, 17), ('ML-IND-SDG', 14, 6), ('ML-IND-SDG', 14, 17), ('ML-IND-SDG', 22, 6), ('ML-IND-SDG', 22, 17),
            ('ML-SDG-SDG', 14, 6), ('ML-SDG-SDG', 14, 17), ('ML-SDG-SDG', 22, 6), ('ML-SDG-SDG', 22, 17), ('MC-IND-TRG', 0, 6), ('MC-IND-TRG', 0, 17)) AS accepted
        FROM (SELECT DISTINCT [0, 14, 22, 15][p_size % 4 + 1] AS goal_count, [6, 17, 5][p_partkey % 3 + 1] AS target_count FROM part), (VALUES ('MC-IND-SDG'), ('MC-IND-TRG'), ('ML-IND-SDG'), ('ML-SDG-SDG'), ('MC-SDG-SDG')) t(task)""",
    "saved_steps": "SELECT vec_id AS step, CASE WHEN vec_id % 5 = 4 THEN (vec_id + 11) || '_model.pt' END AS saved FROM embeddings",
    "fine_tuning_sample": _sampled(),
    "excerpt_order": f"WITH n AS ({O._NUMBERED}) SELECT id, (row_number() OVER (ORDER BY goal, target, begun, doc_id) - 1)::INT AS place FROM n",
}
