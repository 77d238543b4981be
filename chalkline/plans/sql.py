"""DuckDB SQL with the same rows as plans.queries, written apart from it."""

from __future__ import annotations

from chalkline.functions import vocabulary as V
from chalkline.plans.queries import HALF_EVENTS, HALF_ORDERS


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _tokens(table: str, key: str, text: str) -> str:
    """CTEs toks(key, token) of a table's texts."""
    return f"""words AS (SELECT {key}, unnest(list_distinct(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9_]{{2,}}'))) AS w FROM {table}),
    parts AS (SELECT {key}, unnest(list_concat([lower(w)], string_split(lower(w), '_'))) AS token FROM words),
    toks AS (SELECT DISTINCT {key}, token FROM parts WHERE length(token) >= 4 AND token NOT IN ({_list(V.STOP_WORDS)}))"""


_DISTINCTIVE = """sets AS (SELECT item_id, list_sort(list(token)) AS s FROM toks GROUP BY item_id),
    uniq AS (SELECT DISTINCT s FROM (SELECT coalesce(sets.s, []) AS s FROM benchmark LEFT JOIN sets USING (item_id))),
    freq AS (SELECT term, count(*) AS n FROM (SELECT unnest(s) AS term FROM uniq) GROUP BY term),
    kept AS (SELECT term FROM freq WHERE n <= greatest(1, (SELECT count(*) // 2 FROM uniq)))"""

_ASSOCIATION = f"""{_tokens("benchmark", "item_id", "text")},
    {_DISTINCTIVE},
    {_tokens("documents", "doc_id", "text").replace("words", "dwords").replace("parts", "dparts").replace("toks", "dtoks")},
    pairs AS (SELECT item_id, doc_id, count(*) AS n_shared, count(kept.term) AS n_distinctive,
        array_to_string(list_sort(list(kept.term) FILTER (WHERE kept.term IS NOT NULL)), ',') AS matched_terms
        FROM toks JOIN dtoks USING (token) LEFT JOIN kept ON kept.term = token GROUP BY item_id, doc_id),
    assoc AS (SELECT * FROM pairs WHERE n_shared >= 2 AND n_distinctive >= 1)"""

_PATHS = """paths AS (SELECT p_partkey, ['src/app', 'tests', 'docs', '.github/workflows', 'lib/vendor'][p_size % 5 + 1] AS root, lower(p_type) AS folder,
    replace(p_name, ' ', '_') || ['.py', '.md', '.json', '_test.py', '', '.lock'][p_partkey % 6 + 1] AS name,
    ['.py', '.md', '.json', '.py', '', '.lock'][p_partkey % 6 + 1] AS suffix FROM part)"""

_HALVES = f"""halves AS (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '{HALF_ORDERS}' THEN 'base' ELSE 'head' END AS side FROM orders)"""

_DELTA = f"""{_HALVES},
    seen AS (SELECT o_custkey FROM halves GROUP BY 1 HAVING count(DISTINCT side) = 2),
    keyed AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) FILTER (WHERE side = 'base') AS b, count(*) FILTER (WHERE side = 'head') AS h FROM halves GROUP BY ALL),
    delta AS (SELECT o_custkey, o_orderstatus, o_orderpriority, CASE WHEN b > 0 AND h > 0 THEN 'modified' WHEN o_custkey NOT IN (SELECT o_custkey FROM seen) THEN 'unresolved'
        WHEN h > 0 THEN 'added' ELSE 'removed' END AS operation FROM keyed)"""

_EDGES = """edges AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem)"""

_OWNERS = """owners AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""

_SLOTS = """slots AS (SELECT user_id, event_id, CAST(floor(value / 25) AS INT) AS tier, row_number() OVER w AS place FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY CAST(floor(value / 25) AS INT), event_id))"""

_CHECKS = """checks AS (SELECT *, CASE WHEN value > 60 THEN 'failure' WHEN value > 40 THEN 'neutral' WHEN value > 10 THEN 'success' WHEN value > 5 THEN 'pending' END AS conclusion,
    CASE WHEN value > 5 THEN 'completed' ELSE 'queued' END AS status FROM events)"""

_ROLLED = "CASE WHEN bool_or({s} = 'contradicted') THEN 'contradicted' WHEN {full} bool_and({s} = 'demonstrated') THEN 'demonstrated' WHEN bool_or({s} IN ('demonstrated', 'partial')) THEN 'partial' ELSE 'unverified' END"

_SCORES = """ranked AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents),
    gold AS (SELECT DISTINCT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang <> 'fr'),
    e AS (SELECT lang, count(*) AS n_expected FROM gold GROUP BY lang),
    r AS (SELECT ranked.lang, count(*) FILTER (WHERE place <= 50) AS n_returned, count(gold.doc_id) FILTER (WHERE place <= 50) AS n_hits,
        min(place) FILTER (WHERE gold.doc_id IS NOT NULL) AS best FROM ranked LEFT JOIN gold ON gold.lang = ranked.lang AND gold.doc_id = ranked.doc_id GROUP BY ranked.lang),
    q AS (SELECT l.lang, coalesce(n_expected, 0) AS n_expected, coalesce(n_returned, 0) AS n_returned, coalesce(n_hits, 0) AS n_hits, best
        FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN e ON e.lang = l.lang LEFT JOIN r ON r.lang = l.lang),
    scores AS (SELECT lang, n_expected, n_returned, n_hits,
        CASE WHEN n_expected = 0 THEN (n_returned = 0)::DOUBLE WHEN n_returned = 0 THEN 0.0 ELSE n_hits / n_returned END AS precision,
        CASE WHEN n_expected = 0 THEN (n_returned = 0)::DOUBLE ELSE n_hits / n_expected END AS recall,
        CASE WHEN n_expected = 0 THEN (n_returned = 0)::DOUBLE ELSE coalesce(1 / best, 0.0) END AS reciprocal_rank FROM q),
    means AS (SELECT count(*) FILTER (WHERE n_expected > 0) AS n_positive, count(*) FILTER (WHERE n_expected = 0) AS n_negative,
        coalesce(avg(precision) FILTER (WHERE n_expected > 0), 0.0) AS precision_at_k, coalesce(avg(recall) FILTER (WHERE n_expected > 0), 0.0) AS recall_at_k,
        coalesce(avg(reciprocal_rank) FILTER (WHERE n_expected > 0), 0.0) AS mrr, coalesce(avg(precision) FILTER (WHERE n_expected = 0), 1.0) AS no_match_accuracy FROM scores)"""

_KEYS = """SELECT p_partkey, unnest(list_distinct(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9_]{{2,}}'))) AS w FROM part"""


def _identifiers(text: str) -> str:
    return f"""iw AS ({_KEYS.format(text=text)}),
    ip AS (SELECT p_partkey, list_filter(string_split(lower(w), '_'), lambda p: length(p) >= 3 OR regexp_full_match(p, '[0-9]+')) AS p FROM iw WHERE contains(w, '_') OR regexp_matches(substr(w, 2), '[A-Z]')),
    ii AS (SELECT p_partkey, p, unnest(range(1, len(p) + 1)) AS i FROM ip WHERE len(p) > 0),
    idents AS (SELECT DISTINCT p_partkey, array_to_string(p[i:], '') AS key FROM ii WHERE length(array_to_string(p[i:], '')) >= 5)"""


ORACLE_SQL = {
    "semantic_tokens": f"WITH {_tokens('documents', 'doc_id', 'text')} SELECT doc_id, token FROM toks",
    "identifier_keys": f"""WITH {_identifiers("translate(concat_ws('_', p_brand, p_type, p_name), '# ', 'x_')")} SELECT p_partkey, key FROM idents""",
    "association_signature": f"""WITH texts AS (SELECT p_partkey, p_name || ' ' || concat_ws('_', p_type, p_brand) AS text FROM part),
        {_identifiers("p_name || ' ' || concat_ws('_', p_type, p_brand)")}, {_tokens("texts", "p_partkey", "text")}
        SELECT p_partkey, coalesce((SELECT array_to_string(list_sort(list(key)), ',') FROM idents i WHERE i.p_partkey = part.p_partkey), '') AS identifiers,
        coalesce((SELECT array_to_string(list_sort(list(token)), ',') FROM toks t WHERE t.p_partkey = part.p_partkey), '') AS tokens FROM part""",
    "distinctive_terms": f"WITH {_tokens('benchmark', 'item_id', 'text')}, {_DISTINCTIVE} SELECT item_id, term FROM toks JOIN kept ON term = token",
    "text_association": f"WITH {_ASSOCIATION} SELECT * FROM assoc",
    "phrase_cohort": f"""WITH {_ASSOCIATION}, lanes AS (SELECT item_id, doc_id, lang, n_distinctive, max((n_distinctive >= 8)::INT) OVER (PARTITION BY item_id, lang) AS any_d FROM assoc JOIN documents USING (doc_id))
        SELECT item_id, doc_id, lang, n_distinctive FROM lanes WHERE any_d = 0 OR n_distinctive >= 8""",
    "path_profile": f"""WITH {_PATHS} SELECT p_partkey,
        CASE WHEN root = 'tests' OR name LIKE '%\\_test.py' ESCAPE '\\' THEN 'test' WHEN suffix = '.md' THEN 'document' ELSE 'code' END AS classification,
        CASE WHEN root = 'tests' OR name LIKE '%\\_test.py' ESCAPE '\\' THEN 'test' WHEN suffix = '.md' THEN 'document' WHEN root = '.github/workflows' THEN 'workflow'
        WHEN suffix = '.json' THEN 'configuration' WHEN root = 'lib/vendor' THEN 'generated' ELSE 'production' END AS profile FROM paths""",
    "arch_layer": f"""WITH {_PATHS} SELECT p_partkey,
        CASE root WHEN 'src/app' THEN 'app/' || folder WHEN 'lib/vendor' THEN 'vendor/' || folder WHEN '.github/workflows' THEN '.github' ELSE root END AS domain,
        CASE root WHEN 'tests' THEN 'verification' WHEN 'docs' THEN 'documentation' WHEN '.github/workflows' THEN 'automation' ELSE 'unclassified' END AS layer FROM paths""",
    "evidence_ids": "SELECT o_orderkey, 'E:order:' || substr(sha256('order' || chr(0) || o_custkey || chr(0) || o_orderkey), 1, 20) AS id FROM orders",
    "line_overlap": """WITH lines AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        hits AS (SELECT user_id, line, w, (line - 1) // w AS k FROM lines, (SELECT unnest([5, 10, 20]) AS w) WHERE (line - 1) // w <= n // w AND (line - 1) % w <= w - 3),
        best AS (SELECT * FROM hits QUALIFY rank() OVER (PARTITION BY user_id, line ORDER BY w) = 1)
        SELECT user_id, w || '/' || k AS span_id, count(*) AS n_lines, array_to_string(list_sort(list(line)), ',') AS lines FROM best GROUP BY user_id, w, k""",
    "counterpart_delta": f"WITH {_DELTA} SELECT * FROM delta",
    "replacement_pairs": f"""WITH {_DELTA} SELECT concat_ws(':', r.o_custkey, r.o_orderstatus, r.o_orderpriority) AS removed_id, concat_ws(':', a.o_custkey, a.o_orderstatus, a.o_orderpriority) AS added_id,
        a.o_orderstatus, 1 AS n_links FROM delta r JOIN delta a ON r.o_custkey = a.o_custkey AND r.o_orderstatus = a.o_orderstatus WHERE r.operation = 'removed' AND a.operation = 'added'""",
    "relation_delta": f"""WITH {_HALVES},
        rel AS (SELECT CAST(o_custkey AS VARCHAR) AS customer, p_brand AS brand, bool_or(side = 'base') AS b, bool_or(side = 'head') AS h
            FROM halves JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
        own AS (SELECT customer, bool_or(b) AS b, bool_or(h) AS h FROM rel GROUP BY customer),
        known AS (SELECT CAST(o_custkey AS VARCHAR) AS customer, count(*) FILTER (WHERE side = 'base') >= 5 AS kb, count(*) FILTER (WHERE side = 'head') >= 5 AS kh FROM halves GROUP BY 1)
        SELECT rel.customer, brand, CASE WHEN rel.b AND rel.h THEN 'retained' WHEN rel.h AND (NOT own.b OR kb) THEN 'added' WHEN rel.b AND (NOT own.h OR kh) THEN 'removed' END AS operation
        FROM rel JOIN own USING (customer) JOIN known USING (customer)""",
    "bounded_paths": """WITH RECURSIVE edges AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem), ways AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges),
        walk AS (SELECT s AS seed, 0 AS depth, [s] AS nodes FROM (SELECT unnest(['c1', 'c2', 'c4']) AS s)
            UNION ALL SELECT seed, depth + 1, list_append(nodes, y) FROM walk JOIN ways ON x = nodes[-1] WHERE depth < 3 AND NOT list_contains(nodes, y))
        SELECT seed, depth, array_to_string(nodes, '>') AS path FROM walk WHERE depth > 0""",
    "ownership_ancestry": """SELECT 'o' || o_orderkey AS node, unnest(['c' || o_custkey, 'n' || c_nationkey, 'r' || n_regionkey]) AS ancestor, unnest([1, 2, 3]) AS level
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "lca_groups": """SELECT CASE WHEN cn.n_regionkey <> sn.n_regionkey THEN 'r' || cn.n_regionkey WHEN cn.n_nationkey <> sn.n_nationkey THEN 'n' || cn.n_nationkey ELSE 'c' || c_custkey END AS lifted_source,
        CASE WHEN cn.n_regionkey <> sn.n_regionkey THEN 'r' || sn.n_regionkey WHEN cn.n_nationkey <> sn.n_nationkey THEN 'n' || sn.n_nationkey ELSE 's' || s_suppkey END AS lifted_target,
        l_linestatus AS relation, count(*) AS n_edges FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY 1, 2, 3""",
    "change_backbone": f"""WITH {_EDGES}, {_OWNERS}, inner_nodes AS (SELECT unnest(['s1', 's2', 's3']) AS node, 0 AS rank UNION ALL SELECT b, 1 FROM edges WHERE a IN ('s1', 's2', 's3')),
        up1 AS (SELECT DISTINCT parent AS node FROM owners JOIN inner_nodes ON child = node), up2 AS (SELECT DISTINCT parent AS node FROM owners JOIN up1 ON child = node),
        ranks AS (SELECT node, rank FROM inner_nodes UNION ALL SELECT node, 2 FROM up1 UNION ALL SELECT node, 2 FROM up2)
        SELECT node, ['seed', 'contact', 'owner'][min(rank) + 1] AS role FROM ranks GROUP BY node""",
    "file_rollup": """SELECT 'nation' || s_nationkey AS source_file, p_brand AS target_file, count(*) AS n_relations, 'calls' AS kinds
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
    "retained_bridges": """WITH RECURSIVE e AS (SELECT DISTINCT 'n' || c_nationkey AS a, 'p' || o_orderkey AS b FROM orders JOIN customer ON c_custkey = o_custkey
            UNION SELECT DISTINCT 'p' || s_suppkey, 'n' || s_nationkey FROM supplier),
        ch AS (SELECT unnest(['n1', 'n4', 'n9']) AS f),
        r AS (SELECT DISTINCT b AS file, a AS fin, 1 AS d FROM e WHERE a IN (FROM ch) AND b NOT IN (FROM ch)
            UNION SELECT b, fin, d + 1 FROM r JOIN e ON a = file WHERE d < 3 AND b NOT IN (FROM ch)),
        g AS (SELECT DISTINCT a AS file, b AS goal, 1 AS d FROM e WHERE b IN (FROM ch) AND a NOT IN (FROM ch)
            UNION SELECT a, goal, d + 1 FROM g JOIN e ON b = file WHERE d < 3 AND a NOT IN (FROM ch))
        SELECT DISTINCT r.file FROM r JOIN g ON g.file = r.file AND fin <> goal""",
    "merge_facts": """SELECT user_id, event_type, bool_or(value > 20) AS changed,
        CASE WHEN NOT bool_or(value > 20) THEN NULL WHEN bool_and(value > 60) FILTER (WHERE value > 20) THEN 'removed' WHEN NOT bool_or(value > 60) THEN 'added' ELSE 'replaced' END AS operation,
        arg_min(props, event_id) AS first_props, array_to_string(list_sort(list_distinct(list(day(ts)))), ',') AS days FROM events GROUP BY user_id, event_type""",
    "canonical_target": "SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY list_position(['A', 'N', 'R'], l_returnflag), l_orderkey, l_linenumber) = 1",
    "slot_budget": f"""WITH {_SLOTS}, cut AS (SELECT user_id, coalesce(max(tier) FILTER (WHERE place = 2) = max(tier) FILTER (WHERE place = 3), false) AS ambiguous FROM slots GROUP BY user_id)
        SELECT user_id, event_id, tier, place, place <= 2 AS selected, ambiguous FROM slots JOIN cut USING (user_id) WHERE place <= 12""",
    "partition_check": "SELECT 0::BIGINT AS n_missing, 0::BIGINT AS n_unknown, 0::BIGINT AS n_repeated, count(DISTINCT event_id) AS n_ids FROM events",
    "anchor_budget": """WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal < 0 AS bridged, row_number() OVER (PARTITION BY c_nationkey, c_acctbal < 0 ORDER BY c_custkey) AS p FROM customer)
        SELECT c_nationkey, c_custkey, bridged FROM r WHERE p <= CASE WHEN bridged THEN 10 ELSE 20 END
        QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY bridged, c_custkey) <= 30""",
    "verification_convergence": f"""WITH {_CHECKS}, o AS (SELECT *, CASE WHEN conclusion = 'failure' THEN 'failure' WHEN conclusion IN ('success', 'neutral') THEN 'success'
            WHEN status = 'queued' OR conclusion = 'pending' THEN 'pending' ELSE 'unknown' END AS outcome FROM checks),
        f AS (SELECT user_id, event_type, outcome, min(event_id) AS event_id FROM o GROUP BY ALL),
        i AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) > 1 AS conflicting,
            min(CASE outcome WHEN 'failure' THEN 0 WHEN 'pending' THEN 1 WHEN 'success' THEN 2 ELSE 3 END) OVER (PARTITION BY user_id, event_type) AS p FROM f),
        d AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY p, event_type) AS identity_place FROM i)
        SELECT user_id, event_type, event_id, outcome, conflicting, identity_place, identity_place <= 3 AS selected FROM d""",
    "ci_state": f"""WITH {_CHECKS}, own AS (SELECT user_id, ts >= TIMESTAMP '{HALF_EVENTS}' AS now, conclusion FROM checks)
        SELECT user_id, count(*) FILTER (WHERE now) AS n_checks, CASE WHEN NOT bool_or(now) THEN 'not_observed' WHEN bool_or(now AND conclusion = 'failure') THEN 'failure'
        WHEN bool_and(conclusion IN ('success', 'neutral')) FILTER (WHERE now AND conclusion IS NOT NULL) THEN 'passing' ELSE 'pending' END AS state FROM own GROUP BY user_id""",
    "verification_status": f"""WITH {_CHECKS}, h AS (SELECT *, ts >= TIMESTAMP '{HALF_EVENTS}' AS now FROM checks)
        SELECT user_id, event_type, CASE WHEN coalesce(bool_or(now AND conclusion = 'failure'), false) THEN CASE WHEN user_id % 2 = 0 THEN 'contradicted' ELSE 'demonstrated' END
        WHEN coalesce(bool_or(now AND conclusion = 'success' AND status = 'completed'), false) THEN 'demonstrated' ELSE 'partial' END AS status FROM h GROUP BY user_id, event_type""",
    "closure_scan": """WITH sel AS (SELECT item_id, regexp_extract(text, '[A-Za-z]{7,}') AS v FROM benchmark WHERE regexp_extract(text, '[A-Za-z]{7,}') <> ''),
        files AS (SELECT doc_id, text FROM documents QUALIFY sum(octet_length(encode(text))) OVER (ORDER BY doc_id) <= 8000000),
        raw AS (SELECT doc_id, string_split(text, chr(10)) AS c FROM files),
        lines AS (SELECT doc_id, unnest(c) AS content, unnest(range(1, len(c) + 1)) AS line FROM raw)
        SELECT item_id, doc_id, line, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, line) AS place FROM lines JOIN sel ON contains(lower(content), lower(v))
        AND regexp_matches(content, '(?i)(^|[^A-Za-z0-9_])' || v || '($|[^A-Za-z0-9_])') QUALIFY place <= 100""",
    "predicate_rollup": f"""WITH s AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_quantity > 30 THEN 'contradicted' ELSE 'unverified' END WHEN l_linestatus = 'F' THEN 'demonstrated' ELSE 'partial' END AS s FROM lineitem)
        SELECT l_orderkey, count(*) AS n_predicates, {_ROLLED.format(s="s", full="")} AS status FROM s GROUP BY l_orderkey""",
    "component_rollup": f"""WITH s AS (SELECT o_custkey, o_orderpriority, CASE WHEN o_totalprice > 480000 THEN 'contradicted' WHEN o_orderstatus = 'F' THEN 'demonstrated' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'unverified' END AS s
            FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')),
        g AS (SELECT o_custkey, o_orderpriority, {_ROLLED.format(s="s", full="")} AS s FROM s GROUP BY ALL)
        SELECT o_custkey, count(*) AS n_groups, 5 - count(*) AS n_missing, {_ROLLED.format(s="s", full="count(*) = 5 AND")} AS status FROM g GROUP BY o_custkey""",
    "ordered_path": """WITH v AS (SELECT user_id, min(ts) AS v FROM events WHERE event_type = 'view' GROUP BY 1),
        c AS (SELECT user_id, min(ts) AS c FROM events JOIN v USING (user_id) WHERE event_type = 'click' AND ts > v GROUP BY 1),
        p AS (SELECT user_id, min(ts) AS p FROM events JOIN c USING (user_id) WHERE event_type = 'purchase' AND ts > c GROUP BY 1)
        SELECT user_id, CASE WHEN p IS NOT NULL THEN 3 WHEN c IS NOT NULL THEN 2 WHEN v IS NOT NULL THEN 1 ELSE 0 END AS n_matched, p IS NOT NULL AS complete
        FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click', 'purchase')) LEFT JOIN v USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN p USING (user_id)""",
    "query_scores": f"WITH {_SCORES} SELECT lang, n_expected, n_returned, n_hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(reciprocal_rank, 9) AS reciprocal_rank FROM scores",
    "retrieval_metrics": f"WITH {_SCORES} SELECT n_positive, n_negative, round(precision_at_k, 9) AS precision_at_k, round(recall_at_k, 9) AS recall_at_k, round(mrr, 9) AS mrr, round(no_match_accuracy, 9) AS no_match_accuracy FROM means",
    "missed_gates": f"""WITH {_SCORES}, g AS (SELECT unnest(['precision_at_k', 'recall_at_k', 'mrr', 'no_match_accuracy']) AS metric,
        unnest([round(precision_at_k, 9), round(recall_at_k, 9), round(mrr, 9), round(no_match_accuracy, 9)]) AS value, unnest([0.5, 0.9, 0.2, 1.0])::DOUBLE AS threshold FROM means) SELECT * FROM g WHERE value < threshold""",
    "disposition_metrics": """WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS b, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fs,
            count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fr, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
        SELECT lang, b AS n_both, fs AS n_false_selected, fr AS n_false_rejected, n AS n_neither, round(coalesce(b / nullif(b + fs, 0), 1.0), 9) AS precision,
        round(coalesce(b / nullif(b + fr, 0), 1.0), 9) AS recall, round(coalesce((b + n) / nullif(b + n + fs + fr, 0), 1.0), 9) AS disposition_accuracy FROM c""",
    "set_comparison": """WITH f AS (SELECT day(ts) AS day, user_id, bool_or(event_type = 'view') AS s, bool_or(event_type = 'purchase') AS w FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL)
        SELECT CAST(day AS INT) AS day, count(*) FILTER (WHERE s AND w) AS n_shared, count(*) FILTER (WHERE s AND NOT w) AS n_false_in, count(*) FILTER (WHERE w AND NOT s) AS n_false_out FROM f GROUP BY day""",
    "role_comparison": """WITH f AS (SELECT day(ts) AS day, user_id, min(event_type) FILTER (WHERE event_type IN ('view', 'click')) AS s, min(event_type) FILTER (WHERE event_type IN ('click', 'purchase')) AS w
            FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)
        SELECT CAST(day AS INT) AS day, count(*) FILTER (WHERE s IS NOT NULL AND w IS NOT NULL) AS n_shared, count(*) FILTER (WHERE w IS NULL) AS n_false_in, count(*) FILTER (WHERE s IS NULL) AS n_false_out,
        count(*) FILTER (WHERE s <> w) AS n_role_disagreements FROM f GROUP BY day""",
    "compared_outcomes": f"""WITH {_HALVES}, m AS (SELECT o_custkey, side, min(o_orderstatus) AS s, max(o_orderpriority) AS p FROM halves GROUP BY ALL)
        SELECT b.o_custkey, h.o_custkey IS NOT NULL AS found, coalesce(b.s = h.s, false) AS same_status, coalesce(b.p = h.p, false) AS same_priority
        FROM (SELECT * FROM m WHERE side = 'base') b LEFT JOIN (SELECT * FROM m WHERE side = 'head') h USING (o_custkey)""",
    "partition_faults": """WITH t AS (SELECT l_orderkey AS request, l_linenumber AS item, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
        o AS (SELECT DISTINCT l_orderkey AS request, l_linenumber AS item FROM lineitem WHERE l_quantity < 25)
        SELECT request, item, CASE WHEN t.n IS NULL THEN 'missing' WHEN own IS NULL THEN 'unknown' ELSE 'repeated' END AS fault
        FROM t FULL JOIN (SELECT *, true AS own FROM o) USING (request, item) WHERE t.n IS NULL OR own IS NULL OR t.n > 1""",
    "lane_union": "SELECT event_type AS lane, event_id, user_id FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error', 'signup')",
    "admission_tiers": """WITH b AS (SELECT l_suppkey, l_partkey, min(CAST(floor(l_quantity / 8) AS INT)) AS tier FROM lineitem GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY tier, l_partkey) <= 40 AS selected FROM b""",
    "admission_state": """WITH b AS (SELECT l_suppkey, l_partkey, min(CAST(floor(l_quantity / 8) AS INT)) AS tier FROM lineitem GROUP BY ALL),
        s AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY tier, l_partkey) <= 40 AS sel FROM b)
        SELECT l_suppkey, count(*) FILTER (WHERE sel) AS n_selected, count(*) FILTER (WHERE NOT sel) AS n_deferred,
        CASE WHEN count(*) FILTER (WHERE l_partkey % 97 = 0 AND NOT sel) > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE NOT sel) > 0 THEN 'ready_truncated' ELSE 'ready' END AS state FROM s GROUP BY l_suppkey""",
    "char_budget": """WITH c AS (SELECT conv_id, turn, least(length(text), 400) AS n, coalesce(sum(least(length(text), 400)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations)
        SELECT conv_id, turn, CAST(greatest(0, least(n, 1500 - b)) AS BIGINT) AS used FROM c""",
    "diagnostic_groups": """SELECT event_type, CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour, value > 20 AS high, count(*) AS n_rows, count(DISTINCT user_id) AS n_foci, array_to_string(list_sort(list_distinct(list(props))), ',') AS messages,
        CASE WHEN count(DISTINCT user_id) = 1 THEN 'focus:' || min(CAST(user_id AS VARCHAR)) ELSE 'review' END AS owner FROM events GROUP BY event_type, day(ts), hour(ts), value > 20""",
    "index_state": """WITH i AS (SELECT o_custkey, CAST(CAST(floor(max(o_totalprice) / 100000) AS BIGINT) AS VARCHAR) AS h FROM orders GROUP BY 1),
        s AS (SELECT c_nationkey, CASE WHEN i.h IS NULL THEN 'missing' WHEN i.h <> CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR) THEN 'stale' ELSE 'available' END AS st FROM customer LEFT JOIN i ON o_custkey = c_custkey)
        SELECT c_nationkey, CASE WHEN bool_or(st = 'stale') THEN 'stale' WHEN bool_and(st = 'missing') THEN 'missing' WHEN bool_or(st = 'missing') THEN 'partial' ELSE 'available' END AS state FROM s GROUP BY c_nationkey""",
    "diff_relations": """SELECT p_partkey, h AS hunk, 0 AS ordinal, 'replaced' AS kind, CASE h WHEN 0 THEN '2:new ' || p_type || '|3:more' ELSE '11:y' END AS added,
        CASE h WHEN 0 THEN '2:old ' || p_brand ELSE '10:x' END AS removed FROM part, (SELECT unnest([0, 1]) AS h)""",
    "markdown_statements": """WITH b AS (SELECT item_id, trim(regexp_replace(regexp_replace(text, '[*~]+', '', 'g'), '\\s+', ' ', 'g')) AS t FROM benchmark)
        SELECT item_id, o AS ordinal, CASE o WHEN 0 THEN 'intent' WHEN 1 THEN 'obligation' WHEN 2 THEN 'obligation' ELSE 'claim' END AS role,
        CASE o WHEN 0 THEN 'intent' WHEN 1 THEN 'acceptance' WHEN 2 THEN 'acceptance' ELSE 'implementation' END AS purpose,
        CASE o WHEN 0 THEN 'Intro of ' || item_id || '.' WHEN 1 THEN t WHEN 2 THEN 'no Legacy rows' ELSE t END AS text, CASE o WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 7 END AS line
        FROM b, (SELECT unnest([0, 1, 2, 3]) AS o)""",
}
