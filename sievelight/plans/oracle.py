"""DuckDB SQL of the index and of the scoring formulas, for the oracle."""

from __future__ import annotations

from sievelight.functions import notes as N
from sievelight.functions.porter import stem_cte
from sievelight.functions.text import STOPWORDS
from sievelight.schema import CHAMPION_WEIGHTS, Config

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def fold(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '[^\\x00-\\x7F]', '', 'g')"


def token_list(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[a-z0-9]+')"


def kept(word: str) -> str:
    return f"{word} NOT IN ({STOP}) AND length({word}) >= 2 AND regexp_matches({word}, '[a-z]')"


TRIAL = """
lines AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS ls, lang, n_chars FROM documents),
trial AS MATERIALIZED (
  SELECT doc, doc::VARCHAR AS id, coalesce(ls[1], '') AS title, '' AS official, coalesce(ls[3], '') AS summary,
         coalesce(array_to_string(ls[7:], ' '), '') AS description, string_split(coalesce(ls[2], ''), ',') AS conditions,
         string_split(coalesce(ls[4], ''), ',') AS interventions, coalesce(ls[5], '') AS inclusion, coalesce(ls[6], '') AS exclusion,
         CASE lang WHEN 'de' THEN 'Male' WHEN 'fr' THEN 'Female' ELSE 'All' END AS gender,
         (n_chars % 60)::DOUBLE AS min_age, (n_chars % 60)::DOUBLE + 40 AS max_age FROM lines
),
zone_list AS (
  SELECT doc, 0 AS zone, [title, official] AS items FROM trial UNION ALL SELECT doc, 1, [summary] FROM trial
  UNION ALL SELECT doc, 2, [description] FROM trial UNION ALL SELECT doc, 3, conditions FROM trial
  UNION ALL SELECT doc, 4, interventions FROM trial UNION ALL SELECT doc, 5, [inclusion] FROM trial UNION ALL SELECT doc, 6, [exclusion] FROM trial
),
zone_item AS (SELECT doc, zone, unnest(range(len(items)))::INT AS item, unnest(items) AS text FROM zone_list)
"""

TOPIC = f"""
topic AS (
  SELECT item_id::VARCHAR AS qid, text AS note, (20 + item_id % 50)::DOUBLE AS age,
         CASE item_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS sex, (2021 + item_id % 2)::BIGINT AS year FROM benchmark
),
qword AS (
  SELECT qid, word, pos FROM (SELECT qid, unnest(ts) AS word, unnest(range(len(ts)))::INT AS pos FROM (SELECT qid, {token_list('note')} AS ts FROM topic))
  WHERE {kept('word')}
)
"""

WORDS = f"""
word_all AS (
  SELECT doc, zone, item, unnest(range(len(ts)))::INT AS off, unnest(ts) AS word
  FROM (SELECT doc, zone, item, {token_list('text')} AS ts FROM zone_item)
),
kept AS MATERIALIZED (SELECT * FROM word_all WHERE {kept('word')})
"""

STEM = "vocab AS (SELECT word FROM kept UNION SELECT word FROM qword),\n" + stem_cte("vocab").replace("stem AS (", "stem AS MATERIALIZED (")

_TF = ", ".join(f"least(count(*) FILTER (zone = {z}), 255)::INT AS tf{z}" for z in range(7))
_ZLEN = ", ".join(f"count(*) FILTER (zone = {z})::DOUBLE AS zlen{z}" for z in range(7))

INDEX = f"""
item_last AS (SELECT doc, zone, item, max(off) + 64 AS l FROM kept GROUP BY ALL),
item_base AS (
  SELECT doc, zone, item, coalesce(sum(l) OVER (PARTITION BY doc, zone ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM item_last
),
token AS MATERIALIZED (
  SELECT k.doc, k.zone, s.term, (k.zone * 10000000 + b.base + k.off)::INT AS pos
  FROM kept k JOIN item_base b ON b.doc = k.doc AND b.zone = k.zone AND b.item = k.item JOIN stem s ON s.word = k.word
),
posting0 AS (
  SELECT term, doc, {_TF}, coalesce(list_sort(list(pos) FILTER (zone <> 2)), []) AS positions FROM token GROUP BY term, doc
),
posting AS MATERIALIZED (SELECT *, {' + '.join(f'tf{z}' for z in range(7))} AS flat FROM posting0),
zl AS (SELECT doc, {_ZLEN} FROM kept GROUP BY doc),
norm AS (SELECT doc, sqrt(sum(pow(1 + log10(flat::DOUBLE), 2))) AS lnc_norm FROM posting GROUP BY doc),
doc_stat AS MATERIALIZED (
  SELECT t.doc, {', '.join(f'coalesce(zlen{z}, 0) AS zlen{z}' for z in range(7))}, {' + '.join(f'coalesce(zlen{z}, 0)' for z in range(7))} AS len,
         coalesce(lnc_norm, 0) AS lnc_norm FROM trial t LEFT JOIN zl USING (doc) LEFT JOIN norm USING (doc)
),
corpus AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, {', '.join(f'greatest(avg(zlen{z}), 1.0) AS a{z}' for z in range(7))} FROM doc_stat),
df AS (SELECT term, count(*) AS df, count(*) FILTER (tf3 > 0) AS cond_df FROM posting GROUP BY term),
term_stat AS MATERIALIZED (
  SELECT term, df, log10(n / df) AS idf, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS bm25_idf, cond_df, cond_df / df::DOUBLE AS clinical
  FROM df, corpus
)
"""

QTERM = """
qterm AS MATERIALIZED (
  SELECT qid, term, count(*)::DOUBLE AS qtf, min(pos) AS first_pos FROM qword JOIN stem USING (word) GROUP BY qid, term
)
"""

BASE = f"WITH {TRIAL}, {TOPIC}, {WORDS}, {STEM}, {INDEX}, {QTERM}"
#: The same without stemming.
UNSTEMMED = f"WITH {TRIAL}, {TOPIC}, {WORDS}, stem AS MATERIALIZED (SELECT word, word AS term FROM kept UNION SELECT word, word FROM qword), {INDEX}, {QTERM}"


def among(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def cue(n: int) -> str:
    return among(c for c in N.CUES if c.count(" ") == n - 1)


def unmasked(note: str) -> str:
    return f"regexp_replace({note}, '{N.MASKED}', ' ', 'g')"


def _ages() -> str:
    found = []
    for form, scale in N.AGE_FORMS:
        n = f"try_cast(regexp_extract(low, '{form}', 1) AS INTEGER)"
        found.append(f"CASE WHEN regexp_matches(low, '{form}') AND {n} < {N.OLDEST} THEN {{'place': length(regexp_extract(low, '(?s)^(.*?)(?:{form})', 1)), 'age': round({n} * {scale!r}::DOUBLE, 2)}} END")
    return f"(list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)))[1].age"


_NOUNS = "\\b(" + "|".join(N.MALE_NOUNS + N.FEMALE_NOUNS) + ")\\b"


def read_notes(source: str) -> str:
    """CTEs that read the notes (qid, note) of ``source``: nsplit, said (qid, place, word, tag), nkept (its terms' words) and who (qid, age, sex)."""
    head = f"regexp_extract(array_to_string(ws[1:{N.HEAD_WORDS}], ' '), '{_NOUNS}', 1)"
    count = lambda names: f"len(list_filter(ws, lambda w: w IN {among(names)}))"
    return f"""
abbr(short, long) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in N.ABBREVIATIONS.items())}),
nlex AS MATERIALIZED (SELECT qid, lower({unmasked('note')}) AS low, regexp_extract_all({fold(unmasked('note'))}, '{N.NOTE_WORDS}') AS ws FROM {source}),
who AS (
  SELECT qid, {_ages()} AS age,
         CASE WHEN {head} IN {among(N.FEMALE_NOUNS)} THEN 'female' WHEN {head} <> '' THEN 'male'
              WHEN {count(N.FEMALE)} > {count(N.MALE)} THEN 'female' WHEN {count(N.MALE)} > {count(N.FEMALE)} THEN 'male' END AS sex
  FROM nlex
),
nsplit AS (
  SELECT qid, i, unnest(ps) AS w, generate_subscripts(ps, 1) AS j FROM (
    SELECT qid, i, CASE WHEN contains(w, '/') AND w NOT IN {among(N.ABBREVIATIONS)} THEN list_filter(string_split(w, '/'), lambda x: x <> '') ELSE [w] END AS ps
    FROM (SELECT qid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM nlex))
),
nexp AS (
  SELECT qid, i, j, unnest(es) AS word, generate_subscripts(es, 1) AS k
  FROM (SELECT qid, i, j, string_split(coalesce(long, w), ' ') AS es FROM nsplit LEFT JOIN abbr ON short = w)
),
nat AS (SELECT qid, word, (row_number() OVER (PARTITION BY qid ORDER BY i, j, k) - 1)::INT AS place FROM nexp),
nclause AS (
  SELECT * FROM (SELECT *, sum(CASE WHEN word IN {among(N.CLAUSE_ENDS)} THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY place) AS clause FROM nat)
  WHERE word NOT IN {among(N.CLAUSE_ENDS)}
),
ncue AS (
  SELECT *, CASE WHEN concat_ws(' ', word, lead(word) OVER c, lead(word, 2) OVER c) IN {cue(3)} THEN 3
                 WHEN concat_ws(' ', word, lead(word) OVER c) IN {cue(2)} THEN 2 WHEN word IN {cue(1)} THEN 1 ELSE 0 END AS n
  FROM nclause WINDOW c AS (PARTITION BY qid, clause ORDER BY place)
),
nstop AS (
  SELECT *, max(CASE WHEN n > 0 THEN place + n END) OVER (PARTITION BY qid, clause ORDER BY place) AS stop,
         max((word IN {among(N.FAMILY)})::INT) OVER (PARTITION BY qid, clause) AS kin FROM ncue
),
nback AS (SELECT *, word IN {among(N.AFTER_CUES)} AND NOT coalesce(place < stop, false) AS back FROM nstop),
said AS MATERIALIZED (
  SELECT qid, place, word, CASE WHEN kin = 1 THEN 'family'
    WHEN coalesce(max(back::INT) OVER (PARTITION BY qid, clause ORDER BY place ROWS BETWEEN 1 FOLLOWING AND {N.BACK} FOLLOWING), 0) = 1 THEN 'neg'
    WHEN coalesce(place < stop, false) OR back THEN 'cue' WHEN place - stop < {N.SCOPE} THEN 'neg' ELSE 'pos' END AS tag FROM nback
),
nkept AS MATERIALIZED (
  SELECT qid, place, tag, surface, word FROM (SELECT qid, place, tag, word AS surface, unnest(regexp_extract_all(word, '[a-z0-9]+')) AS word FROM said WHERE tag <> 'cue')
  WHERE {kept('word')}
)"""


FINDING = """finding AS MATERIALIZED (
  SELECT qid, term, pos, CASE WHEN pos > neg THEN 0 ELSE neg END AS neg, family, first_pos FROM (
    SELECT qid, term, count(*) FILTER (tag = 'pos') AS pos, count(*) FILTER (tag = 'neg') AS neg, count(*) FILTER (tag = 'family') AS family, min(place) AS first_pos
    FROM nkept JOIN stem USING (word) GROUP BY qid, term)
)"""
#: The same base, with the notes read first; what they do not say of age and sex is taken from the table.
READ = f"""WITH {TRIAL}, {TOPIC.replace('topic AS (', 'topic0 AS (').split('qword AS')[0]} {read_notes('topic0')},
topic AS (SELECT t.qid, note, coalesce(w.age, t.age) AS age, coalesce(w.sex, t.sex) AS sex, year FROM topic0 t JOIN who w USING (qid)),
{WORDS}, {STEM.replace('FROM qword', 'FROM nkept')}, {INDEX}, {FINDING},
qterm AS (SELECT qid, term, pos::DOUBLE AS qtf, first_pos FROM finding WHERE pos > 0),
negterm AS (SELECT qid, term, neg::DOUBLE AS qtf, first_pos FROM finding WHERE neg > 0)"""


def qweight(qtf: str, c: Config) -> str:
    return f"({c.k3 + 1}::DOUBLE * {qtf} / ({c.k3}::DOUBLE + {qtf}))"


def bm25f(c: Config, zone_w: tuple[float, ...] | None = None) -> str:
    parts = [f"{w}::DOUBLE * tf{z} / ({1 - c.zone_b[z]}::DOUBLE + {c.zone_b[z]}::DOUBLE * zlen{z} / a{z})" for z, w in enumerate(zone_w or c.zone_w) if w]
    return "(" + " + ".join(parts) + ")"


def score(c: Config, zone_w: tuple[float, ...] | None = None) -> str:
    if c.model == "tfidf":
        return "weight * (1 + log10(flat::DOUBLE)) / lnc_norm"
    if c.model == "bm25" and zone_w is None:
        f = "flat::DOUBLE"
        sat = f"{f} * {c.k1 + 1}::DOUBLE / ({f} + {c.k1}::DOUBLE * ({1 - c.b}::DOUBLE + {c.b}::DOUBLE * len / ({' + '.join(f'a{z}' for z in range(7))})))"
    else:
        f = bm25f(c, zone_w)
        sat = f"{f} * {c.k1 + 1}::DOUBLE / ({f} + {c.k1}::DOUBLE)"
    return f"bm25_idf * {qweight('qtf', c)} * ({sat})"


IMPACT = "(" + " + ".join(f"tf{z} * {w}::DOUBLE" for z, w in enumerate(CHAMPION_WEIGHTS)) + ") / greatest(lnc_norm, 1.0)"


def champion(most: int) -> str:
    return f"""champion AS (
  SELECT term, doc, impact, rn FROM (
    SELECT term, doc, impact, row_number() OVER (PARTITION BY term ORDER BY impact DESC, doc) AS rn
    FROM (SELECT term, doc, round({IMPACT}, 9) AS impact FROM posting JOIN doc_stat USING (doc))
  ) WHERE rn <= {most}
)"""


def selected(c: Config) -> str:
    """CTEs ``chosen`` (with ranks) and ``sel`` (kept terms, with ltc weights)."""
    cap = f"WHERE term_rank <= {c.max_terms}" if c.max_terms else ""
    return f"""chosen AS (
  SELECT q.*, df, idf, bm25_idf, clinical,
         row_number() OVER (PARTITION BY qid ORDER BY round({qweight('qtf', c)} * idf, 9) DESC, first_pos, q.term) AS term_rank
  FROM qterm q JOIN term_stat t ON t.term = q.term
), sel AS (
  SELECT *, raw / coalesce(nullif(sqrt(sum(raw * raw) OVER (PARTITION BY qid)), 0), 1) AS weight
  FROM (SELECT *, (1 + log10(qtf)) * idf AS raw FROM chosen {cap})
)"""


def scored(c: Config, terms: str = "sel", name: str = "lex") -> str:
    source = "posting JOIN champion USING (term, doc)" if c.champions else "posting"
    return f"""{name} AS (
  SELECT qid, doc, sum({score(c)}) AS score FROM {terms} JOIN {source} USING (term) JOIN doc_stat USING (doc), corpus GROUP BY qid, doc
)"""


ELIGIBLE = "(age IS NULL OR (min_age <= age + 1e-6 AND age <= max_age + 1e-6)) AND (sex IS NULL OR gender = 'All' OR lower(gender) = sex)"


def penalty(c: Config, zone: int, skip: bool, terms: str, name: str) -> str:
    one = tuple(1.0 if z == zone else 0.0 for z in range(7))
    skip_sql = "AND tf3 = 0" if skip else ""
    return f"""{name} AS (
  SELECT qid, doc, sum({score(c, one).replace('weight', 'qtf')}) AS penalty FROM {terms} JOIN posting USING (term) JOIN doc_stat USING (doc), corpus
  WHERE clinical >= {c.pen_ratio}::DOUBLE AND tf{zone} > 0 {skip_sql} GROUP BY qid, doc
)"""


def prf(c: Config) -> str:
    """CTE ``prf``: expansion terms from ``lex``."""
    gate = f"JOIN trial USING (doc) JOIN topic USING (qid) WHERE {ELIGIBLE} AND score > 0" if c.params == "hard" else "WHERE score > 0"
    return f"""best AS (
  SELECT qid, doc FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rn FROM lex {gate}) WHERE rn <= {c.prf_docs}
), votes AS (
  SELECT b.qid, p.term, count(*) AS votes FROM best b JOIN posting p ON p.doc = b.doc AND p.tf3 > 0
  WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.qid = b.qid AND s.term = p.term) GROUP BY b.qid, p.term
), prf AS (
  SELECT qid, term, {c.prf_w}::DOUBLE * votes / n_top AS qtf, rn AS first_pos, df, idf, bm25_idf, clinical FROM (
    SELECT v.qid, v.term, votes, n_top, df, idf, bm25_idf, clinical,
           row_number() OVER (PARTITION BY v.qid ORDER BY round(votes * idf, 9) DESC, v.term) AS rn
    FROM votes v JOIN term_stat t ON t.term = v.term JOIN (SELECT qid, count(*) AS n_top FROM best GROUP BY qid) b ON b.qid = v.qid
  ) WHERE rn <= {c.prf_terms}
)"""


def candidates(c: Config) -> str:
    """CTEs up to ``cand`` (qid, doc, base, exc, neg, ok, final)."""
    parts = [selected(c), *([champion(500)] if c.champions else []), scored(c)]
    total = "lex"
    if c.prf_docs:
        parts += [prf(c), scored(c, "prf", "more"), "summed AS (SELECT qid, doc, sum(score) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM more) GROUP BY qid, doc)"]
        total = "summed"
    exc, neg, joins = "0.0::DOUBLE", "0.0::DOUBLE", ""
    if c.exc_w > 0:
        parts.append(penalty(c, 6, True, "sel", "pexc"))
        exc, joins = "coalesce(e.penalty, 0) / top", joins + " LEFT JOIN pexc e ON e.qid = b.qid AND e.doc = b.doc"
    if c.neg_w > 0:
        parts.append("negated AS (SELECT q.*, df, idf, bm25_idf, clinical FROM negterm q JOIN term_stat t ON t.term = q.term)")
        parts.append(penalty(c, 5, False, "negated", "pneg"))
        neg, joins = "coalesce(g.penalty, 0) / top", joins + " LEFT JOIN pneg g ON g.qid = b.qid AND g.doc = b.doc"
    soft = f" - CASE WHEN ok THEN 0 ELSE {c.soft}::DOUBLE END" if c.params == "soft" else ""
    hard = "WHERE ok" if c.params == "hard" else ""
    parts.append(f"""cand AS (
  SELECT qid, doc, base, exc, neg, ok, base - {c.exc_w}::DOUBLE * exc - {c.neg_w}::DOUBLE * neg{soft} AS final FROM (
    SELECT b.qid, b.doc, score / top AS base, {exc} AS exc, {neg} AS neg, ({ELIGIBLE}) AS ok
    FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM {total} WHERE score > 0) b{joins}
    JOIN trial t ON t.doc = b.doc JOIN topic q ON q.qid = b.qid
  ) {hard}
)""")
    return ",\n".join(parts)


def ranked(source: str, k: int, by: str = "final", name: str = "run") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({by}, 9) DESC, doc) AS rank FROM {source}) WHERE rank <= {k}
)"""


QRELS = """
qrel AS MATERIALIZED (
  SELECT item_id::VARCHAR AS qid, d.doc_id AS doc,
         max(CASE WHEN contains(d.text, b.text) AND len(regexp_extract_all(b.text, '[^ \\n]+')) >= 5 THEN 2 WHEN toxic = 1 THEN 1 ELSE 0 END) AS rel
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id, benchmark b GROUP BY ALL
)
"""


def metrics(run: str, by: str = "qid", name: str = "met") -> str:
    return f"""{name}_j AS (
  SELECT r.*, q.rel AS grade, coalesce(q.rel, 0) AS rel FROM (SELECT * FROM {run} WHERE rank <= 1000) r LEFT JOIN qrel q ON q.qid = r.qid AND q.doc = r.doc
), {name}_i AS (
  SELECT qid, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS idcg, count(*) FILTER (rel = 2) AS n_eligible
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc) AS rank FROM qrel) GROUP BY qid
), {name} AS (
  SELECT {by}, CASE WHEN coalesce(idcg, 0) > 0 THEN dcg / idcg ELSE 0 END AS ndcg10, p10, p10_lenient, rr,
         CASE WHEN coalesce(n_eligible, 0) > 0 THEN found / n_eligible::DOUBLE ELSE 0 END AS r1000, excluded10, judged10
  FROM (
    SELECT {by}, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, (count(*) FILTER (rank <= 10 AND rel = 2)) / 10::DOUBLE AS p10,
           (count(*) FILTER (rank <= 10 AND rel >= 1)) / 10::DOUBLE AS p10_lenient, coalesce(1 / (min(rank) FILTER (rel = 2))::DOUBLE, 0) AS rr,
           count(*) FILTER (rel = 2) AS found, (count(*) FILTER (rank <= 10 AND rel = 1)) / 10::DOUBLE AS excluded10,
           (count(*) FILTER (rank <= 10 AND grade IS NOT NULL)) / 10::DOUBLE AS judged10
    FROM {name}_j GROUP BY {by}
  ) LEFT JOIN {name}_i USING (qid)
)"""


def overlap(note: str, view: str) -> str:
    n = f"list_distinct({token_list(note)})"
    return f"len(list_intersect({n}, {token_list(view)})) / greatest(len({n}), 1)::DOUBLE"


VIEWS = """
views AS (
  SELECT doc, title || '. Conditions: ' || array_to_string(conditions[1:8], '; ') || '. ' || summary AS view0,
         coalesce(nullif(inclusion, ''), title) AS view1, coalesce(nullif(exclusion, ''), 'none') AS view2 FROM trial
)
"""


def minmax(col: str) -> str:
    w = "OVER (PARTITION BY qid)"
    return f"CASE WHEN max({col}) {w} > min({col}) {w} THEN ({col} - min({col}) {w}) / nullif(max({col}) {w} - min({col}) {w}, 0) ELSE 0 END"


def scored_views(c: Config) -> str:
    """CTEs ``first`` and ``seen`` (candidates with view scores)."""
    return f"""{ranked('cand', max(c.k, c.rerank_k), name='first')}, {VIEWS}, seen AS MATERIALIZED (
  SELECT f.*, {overlap('note', 'view0')} AS ce0, {overlap('note', 'view1')} AS ce1, {overlap('note', 'view2')} AS ce2
  FROM first f JOIN topic t ON t.qid = f.qid JOIN views v ON v.doc = f.doc WHERE f.rank <= {c.rerank_k}
)"""
