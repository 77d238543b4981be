"""DuckDB SQL of the operators' queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from chalkline.llm import decontaminate, licences, mixing, ranking, urls, vector_codes
from chalkline.llm.queries import PROBE

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _escaped(c: str, role: bool = False) -> str:
    out = f"replace(replace(replace({c}, '\\', '\\\\'), '</turn', '\\l/turn'), '<turn', '\\lturn')"
    return f"replace({out}, '>', '\\g')" if role else out


OP2 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
  o AS (SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w <> role, true) AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length({_escaped("text")}) + CASE WHEN opens THEN 6 + length({_escaped("role", True)}) + 2 + 8 ELSE 7 END)::BIGINT AS formatted_chars
  FROM o GROUP BY conv_id"""

_DOMAIN = "CASE " + " ".join(f"WHEN left(md5(coalesce(source, '')), 1) IN ({', '.join(repr(d) for d in digits)}) THEN '{name}'" for name, digits in mixing.DOMAINS) + " END"
_WEIGHT = "CASE domain " + " ".join(f"WHEN '{path[0]}' THEN {w}" for path, w in mixing.WEIGHTS.items()) + " END"


def _poured(src: str, parent: str, budget: str, weight: str, key: str) -> str:
    """Columns of src and share: the parent's budget by weight, full nodes at their room."""
    return f"""(SELECT *, CASE WHEN is_full THEN room ELSE ({budget} - coalesce(sum(CASE WHEN is_full THEN room END) OVER (PARTITION BY {parent}), 0)) * {weight}
        / sum(CASE WHEN NOT is_full THEN {weight} END) OVER (PARTITION BY {parent}) END AS share
      FROM (SELECT *, coalesce(sum(room) OVER (PARTITION BY {parent} ORDER BY room / {weight}, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        + room / {weight} * sum({weight}) OVER (PARTITION BY {parent} ORDER BY room / {weight}, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= {budget} AS is_full FROM {src}))"""


OP4 = f"""WITH d AS (SELECT doc_id, {_DOMAIN} AS domain, lang, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
  leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * {mixing.EPOCHS} AS room FROM d GROUP BY ALL),
  dom AS (SELECT domain, sum(room) AS room, {_WEIGHT} AS weight, least(floor((SELECT sum(tokens) FROM d) * {mixing.SHARE}::DOUBLE), (SELECT sum(room) FROM leaf)) AS b, 0 AS root FROM leaf GROUP BY domain),
  pd AS (SELECT domain, share AS b FROM {_poured("dom", "root", "b", "weight", "domain")}),
  lang AS (SELECT leaf.domain, leaf.lang, sum(room) AS room, any_value(pd.b) AS b, 1.0::DOUBLE AS weight FROM leaf JOIN pd USING (domain) GROUP BY leaf.domain, leaf.lang),
  pl AS (SELECT domain, lang, share AS b FROM {_poured("lang", "domain", "b", "weight", "lang")}),
  src AS (SELECT leaf.*, pl.b, 1.0::DOUBLE AS weight FROM leaf JOIN pl ON pl.domain = leaf.domain AND pl.lang IS NOT DISTINCT FROM leaf.lang),
  budgets AS (SELECT domain, lang, source, tokens AS leaf_tokens, floor(share + 1e-6)::BIGINT AS budget FROM {_poured("src", "domain, lang", "b", "weight", "source")}),
  e AS (SELECT d.*, budget - leaf_tokens * epoch AS remaining, leaf_tokens, epoch, md5('{mixing.SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')) AS digest
    FROM d JOIN budgets b ON b.domain = d.domain AND b.lang IS NOT DISTINCT FROM d.lang AND b.source IS NOT DISTINCT FROM d.source, (SELECT unnest(range(0, {mixing.EPOCHS}))::INT AS epoch)),
  s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY digest RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)
  SELECT doc_id, domain, lang, source, epoch, tokens AS n_tokens FROM s WHERE (remaining > 0 OR leaf_tokens = 0 AND epoch = 0) AND (remaining >= leaf_tokens OR upto <= remaining)"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce({}, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5 = f"""WITH b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
  win AS (SELECT DISTINCT item_id, least(len(w), {decontaminate.WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {decontaminate.WINDOW}) - 1], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {decontaminate.WINDOW} + 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
  pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
  hits AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON win.n = pos.n AND gram = array_to_string(w[i:i + pos.n - 1], ' ')),
  covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
  items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id)
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND {decontaminate.SHARE} * n_hit >= len(w) AS contaminated
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licences.TEMPLATES + licences.WRAPPED))
_TERMS = "regexp_extract_all(" + _LOWER.format("{}") + f", '{licences.TERM}')"
_OPENS, _CLOSES, _COMMENT = (x.replace("'", "''") for x in (licences.OPENS, licences.CLOSES, licences.COMMENT))

OP8 = f"""WITH tt AS (SELECT k, name, unnest({_TERMS.format("t")}) AS term FROM (VALUES {_TEMPLATES}) AS v(k, name, t)),
  d AS (SELECT doc_id, text, 'repo' || (doc_id // 256) || '/d' || (doc_id // 16) AS folder, doc_id % 16 = 0 AS is_file, CASE WHEN doc_id % 16 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name FROM documents),
  df AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({_TERMS.format("text")}) AS term FROM d) GROUP BY term),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))) AS idf FROM (SELECT term FROM df UNION SELECT term FROM tt) LEFT JOIN df USING (term)),
  tw AS (SELECT k, name, term, count(*) * any_value(idf) AS x FROM tt JOIN idf USING (term) GROUP BY k, name, term),
  tv AS (SELECT k, name, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS x FROM tw),
  l AS (SELECT *, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL),
  u AS (SELECT doc_id, is_file, text, lines,
      list_filter(regexp_split_to_array(array_to_string(list_transform(lines, lambda x: regexp_replace(regexp_replace(x, '{_OPENS}', ''), '{_CLOSES}', '')), chr(10)), '\\n{{2,}}'), lambda x: contains(x, chr(10))) AS paragraphs,
      CASE WHEN regexp_matches(text, '^\\s*/\\*') THEN split_part(text, '*/', 1) WHEN regexp_matches(text, '^\\s*<!--') THEN split_part(text, '-->', 1)
        ELSE array_to_string(lines[1:coalesce(list_position(list_transform(lines, lambda x: regexp_matches(x, '{_COMMENT}')), false), len(lines) + 1) - 1], chr(10)) END AS header FROM l),
  units AS (SELECT doc_id, unnest(us) AS line, unnest(range(len(us))) AS unit
    FROM (SELECT doc_id, list_concat(lines, paragraphs, [header], CASE WHEN is_file THEN [text] ELSE [] END) AS us FROM u)),
  c AS (SELECT doc_id, unit, term, count(*) AS tf FROM (SELECT doc_id, unit, unnest({_TERMS.format("line")}) AS term FROM units) GROUP BY ALL),
  x AS (SELECT doc_id, unit, term, tf * idf AS x FROM c JOIN idf USING (term)),
  norm AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
  dots AS (SELECT doc_id, unit, k, name, sum(x.x * tv.x) AS dot FROM x JOIN tv USING (term) GROUP BY ALL),
  best AS (SELECT doc_id, arg_min(name, (-score, name)) AS licence, max(score) AS score FROM (SELECT doc_id, name, round(dot / norm, 6) AS score FROM dots JOIN norm USING (doc_id, unit)) WHERE score >= {licences.LEAST_COSINE} GROUP BY doc_id),
  m AS (SELECT d.doc_id, folder, folder || '/' || d.name AS path, is_file, licence, score FROM d LEFT JOIN best USING (doc_id)),
  given AS (SELECT folder, licence AS given FROM m WHERE is_file AND licence IS NOT NULL)
  SELECT doc_id, path, licence AS own_licence, score AS own_score, coalesce(licence, given) AS licence, CASE WHEN licence IS NULL AND given IS NOT NULL THEN folder END AS inherited_from FROM m LEFT JOIN given USING (folder)"""

_FITS = " ".join(
    f"WHEN (host = '{own}' OR host LIKE '%.{own}') AND starts_with(path, '/{rest}') THEN {{{k}}}"
    for k, (own, _, rest) in enumerate(r.partition("/") for _, r in sorted(urls.RULES, key=lambda r: (-len(r[1]), r[1])))
)
_ORDERED = sorted(urls.RULES, key=lambda r: (-len(r[1]), r[1]))
_STRENGTH = f"least(greatest(coalesce(1 / nullif(greatest(CASE WHEN sum(p * (1 - p) * (n - 1)) > 0 THEN (sum((good - n * p) ** 2 / n) - sum(p * (1 - p))) / sum(p * (1 - p) * (n - 1)) END, 0), 0) - 1, {urls.STRENGTH[1]}), {urls.STRENGTH[0]}), {urls.STRENGTH[1]})"


def _level(name: str, rows: str) -> str:
    """CTEs name_in(..., p) and name(..., mean, weight)."""
    return f"{name}_in AS ({rows}), {name}_k AS (SELECT round({_STRENGTH}, 6) AS k FROM {name}_in), {name} AS (SELECT *, (good + p * k) / (n + k) AS mean, n + k AS weight FROM {name}_in, {name}_k)"


OP10 = f"""WITH u AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
  v AS (SELECT *, regexp_replace(regexp_replace(host, '^[^@]*@', ''), '\\.*(:[0-9]*)?$', '') AS site FROM u),
  h AS (SELECT site AS host, n, good, CASE WHEN regexp_matches(site, '^([0-9]+\\.){{3}}[0-9]+$|^\\[') THEN site WHEN two IN {urls.SUFFIX_PAIRS} THEN array_to_string(string_split(site, '.')[-3:], '.') ELSE two END AS domain,
      CASE WHEN regexp_matches(site, '^([0-9]+\\.){{3}}[0-9]+$|^\\[') THEN site WHEN two IN {urls.SUFFIX_PAIRS} THEN two ELSE string_split(site, '.')[-1] END AS suffix
    FROM (SELECT site, array_to_string(string_split(site, '.')[-2:], '.') AS two, count(quality) AS n, coalesce(sum(quality), 0) AS good FROM v LEFT JOIN labels ON doc_id = page_id GROUP BY site)),
  w AS (SELECT coalesce((sum(good) + 1) / (sum(n) + 2), 0.5) AS mean FROM h WHERE n > 0),
  {_level("s", "SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(w.mean) AS p FROM h, w WHERE n > 0 GROUP BY suffix")},
  {_level("m", "SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.good) AS good, any_value(s.mean) AS p FROM h JOIN s USING (suffix) WHERE h.n > 0 GROUP BY h.domain, h.suffix")},
  {_level("o", "SELECT h.host, h.n, h.good, m.mean AS p FROM h JOIN m USING (domain) WHERE h.n > 0")},
  e AS (SELECT h.host, coalesce(o.mean, m.mean, s.mean, w.mean) AS mean, coalesce(o.weight, least(m.weight, {urls.STRENGTH[0]}), {urls.STRENGTH[0]}) AS weight
    FROM h CROSS JOIN w LEFT JOIN o USING (host) LEFT JOIN m ON m.domain = h.domain LEFT JOIN s ON s.suffix = h.suffix),
  l AS (SELECT host, round(mean - {urls.Z} * sqrt(mean * (1 - mean) / (weight + 1)), 6) AS lower_bound FROM e)
  SELECT page_id, host, path, CASE {_FITS.format(*[f"'{r}'" for _, r in _ORDERED])} END AS rule,
    CASE {_FITS.format(*[f"'{v}'" for v, _ in _ORDERED])} WHEN lower_bound >= {urls.LEAST_GOOD} THEN 'allow' ELSE 'block' END AS verdict, lower_bound
  FROM v JOIN (SELECT host AS site, lower_bound FROM l) USING (site)"""



def _lloyd() -> str:
    """Rounds as one CTE after another over (vec_id, part, components) and (part, entry, components)."""
    c = vector_codes
    near = """SELECT vec_id, label, part, v, min(struct_pack(d := d, entry := entry)) AS m FROM (SELECT p.*, entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
      FROM parts p JOIN book_{0} b USING (part)) GROUP BY vec_id, label, part, v"""
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {c.PARTS} + 1:(part + 1) * len(v) // {c.PARTS}] AS v FROM kept, (SELECT unnest(range(0, {c.PARTS})) AS part))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {c.ENTRIES})",
        "book_0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN first USING (vec_id))",
    ]
    for k in range(c.ROUNDS):
        steps.append(f"near_{k} AS MATERIALIZED ({near.format(k)})")
        steps.append(f"""mean_{k} AS (SELECT part, entry, list(x ORDER BY i) AS v FROM (SELECT part, m.entry AS entry, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x
      FROM near_{k}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY part, entry)""")
        steps.append(f"book_{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.v, b.v) AS v FROM book_{k} b LEFT JOIN mean_{k} n USING (part, entry))")
    return "WITH " + ",\n  ".join([
        *steps,
        f"final AS ({near.format(c.ROUNDS)})",
        "coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM final GROUP BY vec_id, label)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book_{c.ROUNDS})",
    ]) + "\n  SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"


OP11 = _lloyd()

_RANKED = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13 = f"""WITH t AS (SELECT doc_id, {_RANKED} AS terms FROM documents),
  s AS (SELECT count(*) AS n, sum(len(terms))::HUGEINT AS l FROM t WHERE len(terms) > 0),
  p AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(terms) AS size, unnest(terms) AS term FROM t) GROUP BY doc_id, term),
  q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_RANKED}) AS term FROM benchmark) GROUP BY item_id, term),
  w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term),
  c AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * s.n) // s.l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id)
  SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM c WHERE score > 0) WHERE rank <= {ranking.TOP}"""

ORACLE_SQL: dict[str, str] = {"op2_chat": OP2, "op4_mixing": OP4, "op5_decontamination": OP5, "op8_licences": OP8, "op10_urls": OP10, "op11_vector_codes": OP11, "op13_ranking": OP13}
