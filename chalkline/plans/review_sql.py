"""DuckDB SQL with the same rows as plans.review_queries, written apart from it."""

from __future__ import annotations

from chalkline.plans.queries import HALF_ORDERS


def _pick(key: str, *values: str | None) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][{key} % {len(values)} + 1]"


_BOUND = """ords AS (SELECT 'r' || o_custkey AS review_id, o_orderpriority AS claim_id, CAST(o_orderkey AS VARCHAR) AS predicate_id, o_orderkey AS k, o_totalprice AS price,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'authority' WHEN '2-HIGH' THEN 'removal' WHEN '3-MEDIUM' THEN 'change' WHEN '4-NOT SPECIFIED' THEN 'completion_condition' ELSE 'after_topology' END AS kind,
        ['symbol', 'repository_path', 'ordered_path'][o_orderkey % 3 + 1] AS sel, CASE o_orderstatus WHEN 'F' THEN 'absent_head' WHEN 'O' THEN 'reference' ELSE 'verified_head' END AS expects FROM orders),
    li AS (SELECT review_id, claim_id, predicate_id, 'p' || l_partkey AS ev, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS b,
        CASE l_returnflag WHEN 'A' THEN 'structural_path' WHEN 'N' THEN 'verification' ELSE 'closure' END AS role,
        ['provided_association', 'exact_identifier', 'structural_bridge', 'distinctive_phrase'][l_linenumber % 4 + 1] AS assoc,
        l_extendedprice > 30000 AS in_order, l_quantity > 40 AS controls, l_quantity < 3 AS bypasses, l_linestatus = 'F' AS whole, l_quantity > 25 AS subject, l_discount > 0.05 AS hit, l_tax < 0.03 AS on_path
        FROM lineitem JOIN ords ON k = l_orderkey),
    bound AS (SELECT * FROM li QUALIFY row_number() OVER (PARTITION BY review_id, claim_id, b ORDER BY in_order) = 1),
    spoken AS (SELECT o.*, x.b, x.ev, x.role, x.assoc, x.in_order, x.controls, x.bypasses, x.whole FROM ords o JOIN bound x ON x.review_id = o.review_id AND x.claim_id = o.claim_id
        WHERE CASE WHEN o.sel = 'ordered_path' THEN EXISTS (SELECT 1 FROM li y WHERE y.review_id = o.review_id AND y.claim_id = o.claim_id AND y.ev = x.ev AND y.on_path)
                OR x.role = 'verification' AND EXISTS (SELECT 1 FROM li y WHERE y.predicate_id = o.predicate_id AND y.ev = x.ev AND y.hit)
            ELSE EXISTS (SELECT 1 FROM li y WHERE y.predicate_id = o.predicate_id AND y.ev = x.ev AND y.subject) OR x.role = 'closure' AND o.expects = 'absent_head' AND o.price > 200000
                OR x.role <> 'closure' AND EXISTS (SELECT 1 FROM li y WHERE y.predicate_id = o.predicate_id AND y.ev = x.ev AND y.hit) OR x.assoc = 'structural_bridge'
                OR o.kind = 'authority' AND x.role = 'structural_path' AND x.assoc = 'provided_association' END)"""

_OVERLAY = """own AS (SELECT 'r' || c_nationkey AS review_id, c_mktsegment AS focus_id, 'c' || c_custkey AS node_id, c_custkey, c_acctbal FROM customer),
    mem AS (SELECT review_id, focus_id, node_id, CASE WHEN c_acctbal <= 0 THEN 4 ELSE [1, 2, 3, 4, 3][c_custkey % 5 + 1] END AS rank, CASE WHEN c_acctbal > 0 THEN 'anchor:' ELSE 'context:' END || c_custkey AS source FROM own
        UNION ALL SELECT review_id, focus_id, unnest([node_id, o_orderpriority]), 4, 'path:o' || o_orderkey FROM orders JOIN own ON o_custkey = c_custkey),
    up AS (SELECT DISTINCT m.review_id, m.focus_id, unnest([m.review_id, 'root']) AS node_id, 4 AS rank, 'owner:' || m.node_id AS source FROM mem m JOIN own o ON o.review_id = m.review_id AND o.node_id = m.node_id),
    overlay AS (SELECT review_id, focus_id, node_id, ['asserted', 'matched', 'suggested', 'context'][min(rank)] AS membership, count(DISTINCT source) AS n_sources FROM (FROM mem UNION ALL FROM up) GROUP BY review_id, focus_id, node_id)"""

_ROLLED = "CASE WHEN bool_or(s = 'contradicted') THEN 'contradicted' WHEN bool_and(s = 'demonstrated') THEN 'demonstrated' WHEN bool_or(s IN ('demonstrated', 'partial')) THEN 'partial' ELSE 'unverified' END"

_REQUIREMENTS = f"""SELECT p_partkey, p_partkey % 7 AS s, p_size, {_pick("p_partkey", "No ", "Do not ", "Test that ", "Docs must cover ", "Render ", "The schema keeps ", "Remove ")} AS start FROM part"""

ORACLE_SQL = {
    "requirement_rules": f"""WITH r AS ({_REQUIREMENTS}), p AS (SELECT *, CASE WHEN s < 2 THEN 'guardrail' ELSE 'deliverable' END AS kind,
            CASE s WHEN 0 THEN 'guardrail' WHEN 1 THEN 'guardrail' WHEN 2 THEN 'test_verification' WHEN 3 THEN 'documentation' WHEN 4 THEN 'ui' WHEN 5 THEN 'schema_migration' ELSE 'generic' END AS profile FROM r)
        SELECT p_partkey, kind, profile, p_size % 2 = 0 AS asks_success, CASE WHEN p_size % 3 = 0 AND profile <> 'documentation' THEN 'document_support' WHEN p_size % 3 = 1 AND profile <> 'test_verification' THEN 'test_support' ELSE 'primary' END AS role,
        s = 6 AS removal FROM p""",
    "claim_predicates": """WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS review_id, p_partkey % 4 AS s, p_size % 5 AS k, array_to_string(list_transform(string_split(p_name, ' '), lambda w, i: CASE WHEN i = 1 THEN upper(w[1]) || w[2:] ELSE w END), '') AS name,
            lower(replace(p_brand, '#', '_')) AS brand FROM part),
        e AS (SELECT *, CASE k WHEN 0 THEN 'verified_head' WHEN 1 THEN 'absent_head' WHEN 2 THEN 'present_head' WHEN 3 THEN 'reference' ELSE 'present_base' END AS ex FROM c)
        SELECT review_id, 'TP:T1:1' AS predicate_id, CASE WHEN s < 2 THEN 'symbol' ELSE 'ordered_path' END AS selector_kind, CASE s WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN name || ',' || brand ELSE name || ',' || brand || ',end' END AS values,
            CASE WHEN s = 1 AND k = 0 THEN 'absent_head' ELSE ex END AS expectation, 'target' AS role FROM e
        UNION ALL SELECT review_id, 'TP:T1:2', 'repository_path', CASE s WHEN 0 THEN 'src/' || brand || '/' ELSE brand || '.py' END, ex, CASE s WHEN 0 THEN 'path_scope' ELSE 'target' END FROM e WHERE s < 2""",
    "selector_rules": """WITH v AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w, p_size % 5 AS e, p_partkey % 7 AS f FROM part),
        a AS (SELECT *, w[1] || w[2] AS joined, w[1] || '_' || w[2] AS snake FROM v),
        k AS (SELECT *, list_concat(CASE WHEN length(joined) >= 5 THEN [joined] ELSE [] END, CASE WHEN length(w[2]) >= 5 THEN [w[2]] ELSE [] END,
            CASE e WHEN 0 THEN ['run'] WHEN 2 THEN ['py'] WHEN 3 THEN [snake || 'y'] ELSE [snake] END) AS ks FROM a)
        SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(ks, lambda x: length(x) >= 3))), ',') AS keys, CASE WHEN e = 2 THEN 'repository_path' ELSE 'symbol' END AS kind, e = 4 AS spelled,
        CAST([1, 2, 3, 8, 9, 10, 11][f + 1] AS INT) AS rank FROM k""",
    "links": """SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://[^/\\s?#]+') THEN url END AS href,
        'https://x/o/r/blob/h/src/p' || page_id || '.py' || CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 2 = 0 THEN '#L' || page_id % 9 ELSE '#L' || page_id % 9 || '-L' || (page_id % 9 + 1) END AS blob,
        'https://x/o/r/pull/1/files#diff-' || sha256('src/p' || page_id || '.py') || CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 2 = 0 THEN 'L' || page_id % 9 ELSE 'R' || page_id % 9 END AS diff FROM pages""",
    "evidence_eligibility": f"""WITH r AS (SELECT p_partkey, {_pick("p_size", "change", "relation_change", "structural_path", "verification", None)} AS role, {_pick("p_partkey", "test", "production", "document")} AS profile,
            {_pick("p_partkey", "removed", "added", "replaced", "modified")} AS op, p_size % 2 = 0 AS base, p_size % 3 = 0 AS head,
            unnest(['change', 'test_migration', 'production_path', 'before_topology', 'after_topology', 'removal', 'completion_condition', 'authority', 'before_state', 'uncertainty']) AS kind FROM part),
        e AS (SELECT *, coalesce(CASE WHEN role IS NULL OR kind IN ('before_state', 'uncertainty') THEN false WHEN kind = 'test_migration' THEN profile = 'test' AND role IN ('change', 'structural_path')
            WHEN kind = 'production_path' THEN profile = 'production' OR role IN ('relation_change', 'structural_path') WHEN kind = 'before_topology' THEN base WHEN kind = 'after_topology' THEN head
            WHEN kind = 'removal' THEN role IN ('change', 'relation_change') AND (op IN ('removed', 'replaced') OR base) WHEN kind = 'completion_condition' THEN true
            WHEN kind = 'authority' THEN role IN ('change', 'relation_change') ELSE role IN ('change', 'relation_change', 'structural_path') END, false) AS eligible FROM r)
        SELECT p_partkey, kind, eligible, CASE WHEN kind = 'before_state' THEN base ELSE eligible END AS admissible FROM e""",
    "graph_states": f"""SELECT o_orderkey, {_pick("o_orderkey", "asserted", "matched", "suggested", "context")} AS membership,
        CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 4 = 0 AND o_custkey % 2 = 0 THEN 'modified' WHEN o_orderkey % 2 = 0 THEN 'retained' ELSE 'unresolved' END AS delta,
        CASE WHEN o_orderkey % 11 = 0 THEN 'projected' WHEN o_orderkey % 7 = 0 THEN 'deferred' WHEN o_orderkey % 13 = 0 THEN 'non_structural_only' WHEN o_orderkey % 3 = 0 THEN 'unassociated' WHEN o_orderkey % 3 = 1 THEN 'unavailable' ELSE 'no_structural_evidence' END AS disposition,
        CASE WHEN o_orderkey % 11 = 0 THEN 'projected' WHEN o_orderkey % 7 = 0 THEN 'deferred' WHEN o_custkey % 2 = 0 THEN 'not_applicable' WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'unassociated' ELSE 'no_structural_evidence' END AS claim_disposition,
        o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AND o_custkey % 2 = 0 AS structural FROM orders""",
    "scan_surfaces": """WITH f AS (SELECT lang AS review_id, 'src/' || source || '/doc' || doc_id || '.py' AS path, text FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY path) <= 2000),
        c AS (SELECT item_id, ['en', 'de', 'fr', 'es'][item_id % 4 + 1] AS review_id, unnest([1, 2, 3]) AS n, unnest(['identifier', 'path', 'phrase']) AS kind,
            unnest([regexp_extract(text, '[A-Za-z]{7,}'), 'doc' || item_id, lower(regexp_extract(text, '^[^ ]+ [^ ]+'))]) AS v FROM benchmark),
        p AS (SELECT review_id, 'CSP:T' || item_id AS plan_id, kind, v, row_number() OVER (PARTITION BY item_id ORDER BY n) AS n FROM c WHERE v <> '' AND NOT (kind = 'phrase' AND item_id % 2 = 1)),
        z AS (SELECT plan_id, path, text FROM f JOIN (SELECT DISTINCT plan_id, review_id FROM p WHERE kind <> 'path') USING (review_id)
            QUALIFY sum(octet_length(encode(text))) OVER (PARTITION BY plan_id ORDER BY path) <= 8000000),
        l AS (SELECT p.*, path, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM z JOIN p USING (plan_id) WHERE kind <> 'path'),
        m AS (SELECT review_id, plan_id, n, 'paths' AS surface, path, 0 AS line, path AS excerpt, 0 AS turn, 0 AS pos FROM p JOIN f USING (review_id) WHERE kind = 'path' AND regexp_matches(path, '(?i)(^|[^A-Za-z0-9_])' || v || '($|[^A-Za-z0-9_])')
            UNION ALL SELECT review_id, plan_id, n, 'file_content', path, line, substr(trim(content), 1, 240), 1, 0 FROM l WHERE CASE kind WHEN 'phrase' THEN contains(lower(content), v) ELSE contains(lower(content), lower(v)) AND regexp_matches(content, '(?i)(^|[^A-Za-z0-9_])' || v || '($|[^A-Za-z0-9_])') END
            UNION ALL SELECT review_id, plan_id, n, 'symbol_names', path, line, sym, 2, pos FROM (SELECT *, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS sym, unnest(range(len(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')))) AS pos
                FROM l WHERE kind = 'identifier' AND contains(lower(content), lower(v))) WHERE lower(sym) = lower(v)),
        o AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY turn > 0, path, line, turn, pos, n) AS place FROM m)
        SELECT review_id, plan_id || ':predicate:' || n AS predicate_id, 'CSM:' || substr(sha256(concat_ws(chr(0), plan_id, plan_id || ':predicate:' || n, 'head', plan_id || ':predicate:' || n || ':target', surface, path, line)), 1, 16) AS match_id,
        surface, path, nullif(line, 0) AS line, excerpt, place FROM o WHERE place <= 100""",
    "predicate_status": f"""WITH {_BOUND},
        chk AS (SELECT 'p' || p_partkey AS ev, p_retailprice > 950 AND p_size % 3 = 1 AS failed, p_retailprice > 950 AND p_size % 3 = 0 AS passed FROM part),
        g AS (SELECT predicate_id, count(DISTINCT b) AS n_all, count(DISTINCT b) FILTER (WHERE assoc IN ('provided_association', 'exact_identifier')) AS n_exact, count(DISTINCT b) FILTER (WHERE role = 'closure') AS n_closure,
            count(DISTINCT b) FILTER (WHERE role = 'verification') AS n_check, count(DISTINCT b) FILTER (WHERE role = 'verification' AND failed) AS n_failed, count(DISTINCT b) FILTER (WHERE role = 'verification' AND passed) AS n_passed,
            count(DISTINCT b) FILTER (WHERE role = 'structural_path' AND in_order) AS n_order, count(DISTINCT b) FILTER (WHERE controls) AS n_control, count(DISTINCT b) FILTER (WHERE bypasses) AS n_bypass, coalesce(bool_or(controls AND NOT whole), false) AS cut
            FROM spoken JOIN chk USING (ev) GROUP BY predicate_id),
        j AS (SELECT o.*, k % 2 AS deferred, k % 5 = 0 AS uncertain, price > 200000 AS planned, kind = 'removal' AS transition, k % 4 <> 0 AS bc, k % 7 <> 0 AS hc, k % 3 AS bm, k % 5 AS hm, coalesce(n_all, 0) AS a, coalesce(n_exact, 0) AS e, coalesce(n_closure, 0) AS c,
            coalesce(n_check, 0) AS v, coalesce(n_failed, 0) AS f, coalesce(n_passed, 0) AS p, coalesce(n_order, 0) AS o_, coalesce(n_control, 0) AS t, coalesce(n_bypass, 0) AS y, coalesce(cut, false) AS cut FROM ords o LEFT JOIN g USING (predicate_id)),
        s AS (SELECT *, CASE WHEN f > 0 THEN 'contradicted' WHEN p > 0 THEN 'demonstrated' ELSE 'partial' END AS vs, CASE WHEN f > 0 THEN 0 WHEN p > 0 THEN p ELSE v END AS vn,
            CASE WHEN transition THEN CASE WHEN bc AND hc AND bm > 0 AND hm = 0 THEN 'demonstrated' WHEN hc AND hm > 0 THEN 'contradicted' WHEN NOT hc OR NOT bc THEN 'partial' ELSE 'unverified' END
                WHEN expects = 'absent_head' THEN CASE WHEN hc AND hm > 0 THEN 'contradicted' WHEN hc THEN 'demonstrated' ELSE 'partial' END ELSE CASE WHEN hc THEN 'unverified' ELSE 'partial' END END AS cs,
            CASE WHEN kind = 'authority' THEN 'authority' WHEN sel = 'ordered_path' THEN 'order' WHEN c > 0 AND planned THEN 'scan' WHEN expects = 'verified_head' AND v > 0 THEN 'check' WHEN e > 0 THEN 'exact' WHEN a > 0 THEN 'any' ELSE 'none' END AS way FROM j)
        SELECT predicate_id,
        CASE way WHEN 'authority' THEN CASE WHEN y > 0 THEN 'contradicted' WHEN t > 0 THEN CASE WHEN deferred > 0 OR cut OR uncertain THEN 'partial' ELSE 'demonstrated' END WHEN e > 0 OR deferred > 0 THEN 'partial' ELSE 'unverified' END
            WHEN 'order' THEN CASE WHEN o_ = 0 THEN CASE WHEN deferred > 0 THEN 'partial' ELSE 'unverified' END WHEN expects = 'absent_head' THEN 'contradicted' WHEN expects <> 'verified_head' THEN 'demonstrated' WHEN v = 0 THEN 'partial' ELSE vs END
            WHEN 'scan' THEN cs WHEN 'check' THEN vs WHEN 'exact' THEN CASE WHEN kind = 'change' AND expects = 'reference' THEN 'demonstrated' ELSE 'partial' END WHEN 'any' THEN 'partial' ELSE 'unverified' END AS status,
        CASE way WHEN 'authority' THEN CASE WHEN y > 0 THEN 'authority_bypass_observed' WHEN t > 0 THEN 'authority_path_observed' WHEN deferred > 0 THEN 'coverage_incomplete' WHEN e > 0 THEN 'association_only' ELSE 'no_binding' END
            WHEN 'order' THEN CASE WHEN o_ = 0 THEN CASE WHEN deferred > 0 THEN 'coverage_incomplete' ELSE 'no_binding' END WHEN expects = 'absent_head' THEN 'closure_conflict_observed' ELSE 'exact_fact_observed' END
            WHEN 'scan' THEN CASE cs WHEN 'contradicted' THEN 'closure_conflict_observed' WHEN 'demonstrated' THEN CASE WHEN transition THEN 'closure_transition_observed' ELSE 'closure_absence_observed' END WHEN 'partial' THEN 'coverage_incomplete' ELSE 'association_only' END
            WHEN 'check' THEN CASE WHEN f > 0 THEN 'verification_failure_observed' WHEN p > 0 THEN 'verification_success_observed' ELSE 'verification_incomplete' END
            WHEN 'exact' THEN CASE WHEN kind = 'change' AND expects = 'reference' THEN 'exact_fact_observed' ELSE 'association_only' END WHEN 'any' THEN 'association_only' ELSE 'no_binding' END AS reason,
        CAST(CASE way WHEN 'authority' THEN CASE WHEN y > 0 OR t > 0 THEN t ELSE e END WHEN 'order' THEN CASE WHEN o_ = 0 OR expects = 'absent_head' THEN 0 WHEN expects <> 'verified_head' OR v = 0 THEN o_ ELSE o_ + vn END
            WHEN 'scan' THEN CASE WHEN cs = 'contradicted' THEN 0 ELSE c END WHEN 'check' THEN vn WHEN 'exact' THEN e WHEN 'any' THEN a ELSE 0 END AS INT) AS n_supporting,
        CAST(CASE way WHEN 'authority' THEN y WHEN 'order' THEN CASE WHEN o_ > 0 AND expects = 'absent_head' THEN o_ WHEN o_ > 0 AND expects = 'verified_head' AND v > 0 THEN f ELSE 0 END
            WHEN 'scan' THEN CASE WHEN cs = 'contradicted' THEN c ELSE 0 END WHEN 'check' THEN f ELSE 0 END AS INT) AS n_contradicting FROM s""",
    "merged_members": """WITH m AS (SELECT l_partkey, max(l_returnflag) AS l_returnflag, coalesce(max(l_linestatus) FILTER (WHERE l_quantity >= 45), 'unresolved') AS delta, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS suppliers,
            count(DISTINCT l_returnflag) > 1 AS a, count(DISTINCT l_linestatus) FILTER (WHERE l_quantity >= 45) > 1 AS b FROM lineitem GROUP BY l_partkey)
        SELECT l_partkey, l_returnflag, delta, suppliers, CASE WHEN a AND b THEN 'delta,l_returnflag' WHEN a THEN 'l_returnflag' WHEN b THEN 'delta' END AS conflicts FROM m""",
    "relation_changes": """WITH s AS (SELECT DISTINCT CASE WHEN year(l_shipdate) < 1998 THEN 'base' ELSE 'head' END AS side, l_suppkey, l_partkey, l_linestatus FROM lineitem),
        g AS (SELECT l_suppkey, l_partkey, l_linestatus, bool_or(side = 'base') AS b, bool_or(side = 'head') AS h FROM s GROUP BY l_suppkey, l_partkey, l_linestatus),
        d AS (SELECT g.*, CASE WHEN b AND h THEN 'retained' WHEN h AND (p_size < 5 OR l_suppkey % 3 <> 0) THEN 'added' WHEN b AND (p_size > 45 OR l_suppkey % 3 <> 0) THEN 'removed' END AS operation FROM g JOIN part ON p_partkey = l_partkey)
        SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_linestatus AS relation, operation FROM d WHERE operation IS NOT NULL""",
    "ownership_changes": f"""WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, o_orderpriority, o_orderdate < TIMESTAMP '{HALF_ORDERS}' AS base FROM orders JOIN customer ON c_custkey = o_custkey),
        g AS (SELECT c_nationkey, c_custkey, any_value(c_acctbal) AS bal, o_orderpriority, bool_or(base) AS b, bool_or(NOT base) AS h FROM r GROUP BY c_nationkey, c_custkey, o_orderpriority),
        k AS (SELECT c_custkey, bool_or(base) AS kb, bool_or(NOT base) AS kh FROM r GROUP BY c_custkey)
        SELECT 'n' || c_nationkey AS review_id, o_orderpriority AS parent, 'c' || c_custkey AS child, CASE WHEN b AND h THEN 'retained' WHEN h AND (bal < 0 AND c_custkey % 2 = 0 OR c_nationkey % 2 = 0 AND kb) THEN 'added'
        WHEN b AND (bal < 0 AND c_custkey % 2 = 1 OR c_nationkey % 2 = 0 AND kh) THEN 'removed' END AS operation FROM g JOIN k USING (c_custkey)""",
    "focus_overlay": f"WITH {_OVERLAY} SELECT review_id, focus_id, node_id, membership, CAST(n_sources AS INT) AS n_sources FROM overlay",
    "observed_focuses": f"""WITH {_OVERLAY} SELECT review_id, focus_id, CAST(count(*) FILTER (WHERE membership IN ('asserted', 'matched')) AS INT) AS n_direct, CAST(count(*) FILTER (WHERE membership = 'suggested') AS INT) AS n_suggested,
        CAST(count(*) FILTER (WHERE membership = 'context') AS INT) AS n_context, 0 AS n_unresolved, 0 AS n_exact_relations FROM overlay GROUP BY review_id, focus_id""",
    "verification_matrix": f"""WITH {_OVERLAY}, st AS (SELECT review_id, focus_id, CASE WHEN c_acctbal < -500 THEN 'contradicted' WHEN c_acctbal > 9000 THEN 'demonstrated' ELSE 'partial' END AS s FROM own WHERE c_custkey % 4 = 0),
        ro AS (SELECT review_id, focus_id, {_ROLLED} AS status FROM st GROUP BY review_id, focus_id)
        SELECT q.review_id, q.focus_id AS subject_id, coalesce(status, 'unverified') AS status, CAST(q.n AS INT) AS n_evidence, coalesce(w.n, 0) AS n_nodes
        FROM (SELECT review_id, focus_id, count(*) FILTER (WHERE c_acctbal > 5000) AS n FROM own GROUP BY review_id, focus_id) q LEFT JOIN ro USING (review_id, focus_id)
        LEFT JOIN (SELECT review_id, focus_id, count(*) AS n FROM overlay GROUP BY review_id, focus_id) w USING (review_id, focus_id)""",
    "claim_closure": """WITH g AS (SELECT 'r' || s_nationkey AS review_id, CAST(s_suppkey % 3 AS VARCHAR) AS claim_id, 'p' || l_partkey AS path_id, CAST(min(p_size // 10) AS INT) AS depth
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)
        SELECT *, depth <= 3 AND row_number() OVER (PARTITION BY review_id, claim_id ORDER BY depth, path_id) <= 30 AS selected FROM g""",
    "claim_bindings": """WITH o AS (SELECT 'r' || o_custkey AS review_id, o_orderpriority AS claim_id, CAST(o_orderkey AS VARCHAR) AS evidence_id, o_totalprice AS p, o_orderkey % 3 = 0 AS w FROM orders),
        b AS (SELECT review_id, claim_id, evidence_id, CASE WHEN p > 300000 THEN 'provided_association' WHEN p > 250000 THEN 'exact_identifier' ELSE 'distinctive_phrase' END AS association,
            CASE WHEN p > 400000 THEN 'closure' WHEN p > 300000 THEN 'subject' ELSE 'lexical' END AS origin FROM o WHERE p > 300000 OR w)
        SELECT * FROM b UNION ALL SELECT review_id, claim_id, NULL, CASE WHEN bool_or(p < 50000) THEN 'no_association' ELSE 'no_eligible_fact' END, 'none' FROM o
        WHERE (review_id, claim_id) NOT IN (SELECT (review_id, claim_id) FROM b) GROUP BY review_id, claim_id""",
    "authority_bypasses": """WITH n AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS nodes FROM lineitem GROUP BY l_orderkey),
        au AS (SELECT ['1-URGENT', '2-HIGH', '5-LOW'][s_suppkey % 3 + 1] AS claim_id, list(s_suppkey) AS auth FROM supplier WHERE s_acctbal > 8000 GROUP BY 1),
        bo AS (SELECT o_orderkey AS k, o_orderpriority AS claim_id FROM orders WHERE o_orderstatus = 'P'),
        sinks AS (SELECT DISTINCT claim_id, nodes[-1] AS sink FROM bo JOIN n USING (k) JOIN au USING (claim_id) WHERE list_has_any(nodes[:-2], auth))
        SELECT claim_id, 'o' || k AS path_id FROM n JOIN sinks ON sink = nodes[-1] JOIN au USING (claim_id) WHERE NOT list_has_any(nodes, auth) AND (k, claim_id) NOT IN (SELECT (k, claim_id) FROM bo)""",
    "check_facts": f"""WITH r AS (SELECT event_id, event_type, {_pick("user_id", "Actions", "", " Other ")} AS pv, {_pick("event_id", "Completed", "queued", None)} AS st, {_pick("event_id", "SUCCESS", None, "failure", "neutral")} AS co FROM events)
        SELECT 'E:verification:' || substr(sha256('verification' || chr(0) || event_id), 1, 20) AS id, '  ' || upper(event_type) || '  Run : ' || st || '/' || coalesce(co, 'no conclusion') AS summary,
        CASE WHEN trim(pv) = '' THEN 'unknown' ELSE lower(trim(pv)) END AS provider, event_type || ' run' AS name, coalesce(lower(st), 'unknown') AS status, coalesce(lower(co), '') AS conclusion, 'ci' AS classification FROM r""",
    "change_facts": """WITH r AS (SELECT l_orderkey, l_suppkey, l_linenumber AS n, 'src/p' || l_partkey || '.py' AS path, ['added', 'removed', 'replaced'][l_linenumber % 3 + 1] AS kind FROM lineitem)
        SELECT 'E:change_relation:' || substr(sha256('change_relation' || chr(0) || 'hunk:' || l_orderkey || ':change:' || l_suppkey || ':' || CASE WHEN kind = 'removed' THEN '' ELSE CAST(n AS VARCHAR) END), 1, 20) AS id,
        upper(kind[1]) || kind[2:] || ' change: ' || path || ':' || n || '-' || n AS summary, path, kind AS operation, CASE WHEN kind = 'removed' THEN 'base' ELSE 'head' END AS revision_side, 'production' AS profile FROM r
        UNION ALL SELECT 'E:changed_file:' || substr(sha256('changed_file' || chr(0) || 'src/p' || p_partkey || '.py'), 1, 20), 'Added file: src/p' || p_partkey || '.py', 'src/p' || p_partkey || '.py', 'added', 'head', 'production'
        FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""",
    "shadow_run": """WITH q AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3 AS ran FROM orders),
        g AS (SELECT o_custkey, count(*) FILTER (WHERE ran) AS n_runs, count(*) FILTER (WHERE ran AND o_orderkey % 4 <> 0) AS ok FROM q GROUP BY o_custkey)
        SELECT 'r' || o_custkey AS review_id, n_runs, CASE WHEN n_runs = 0 THEN 'empty' WHEN ok = 0 THEN 'failed' WHEN ok < n_runs THEN 'partial' ELSE 'completed' END AS state FROM g""",
    "shadow_comparison": """SELECT 'r' || o_custkey AS review_id, o_orderpriority AS claim_id, CAST(o_orderkey AS VARCHAR) AS evidence_id,
        CASE WHEN o_totalprice > 200000 AND o_orderstatus <> 'O' THEN 'shared' WHEN o_totalprice > 200000 THEN 'deterministic_only' ELSE 'shadow_only' END AS side FROM orders WHERE o_totalprice > 200000 OR o_orderstatus <> 'O'""",
    "shadow_metrics": """WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
        e AS (SELECT doc_id, CASE WHEN q = 1 THEN 'selected' WHEN t = 1 THEN 'rejected' ELSE 'insufficient' END AS ed, CASE WHEN q = 1 THEN ['a', 'b'][doc_id % 2 + 1] END AS er FROM l),
        x AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'rejected' ELSE ed END AS od, CASE WHEN doc_id % 5 <> 0 THEN 'a' END AS o_role, doc_id % 4 = 0 AS base FROM e),
        c AS (SELECT count(*) AS n_labels, count(*) FILTER (WHERE ed = 'selected') AS n_expected, count(*) FILTER (WHERE od = 'selected') AS n_observed, count(*) FILTER (WHERE ed = 'selected' AND od = 'selected') AS n_shared,
            count(*) FILTER (WHERE ed = 'selected' AND od = 'selected' AND er IS NOT DISTINCT FROM o_role) AS n_roles, count(*) FILTER (WHERE ed = od) AS n_dispositions, count(*) FILTER (WHERE ed = 'selected' AND od = 'rejected') AS n_false_rejected,
            count(*) FILTER (WHERE ed = 'insufficient') AS n_insufficient, count(*) FILTER (WHERE ed = 'insufficient' AND od = 'insufficient') AS n_insufficient_shared, count(*) FILTER (WHERE ed = 'selected' AND base) AS n_baseline,
            count(*) FILTER (WHERE ed = 'selected' AND od = 'selected' AND base) AS n_baseline_kept FROM x)
        SELECT *, round(coalesce(n_shared / nullif(n_observed, 0), 1.0), 9) AS selection_precision, round(coalesce(n_shared / nullif(n_expected, 0), 1.0), 9) AS selection_recall, round(coalesce(n_roles / nullif(n_expected, 0), 1.0), 9) AS role_accuracy,
        round(coalesce(n_dispositions / nullif(n_labels, 0), 1.0), 9) AS disposition_accuracy, round(coalesce(n_false_rejected / nullif(n_expected, 0), 1.0), 9) AS false_rejection_rate,
        round(coalesce(n_insufficient_shared / nullif(n_insufficient, 0), 1.0), 9) AS insufficient_recall, round(coalesce(n_baseline_kept / nullif(n_baseline, 0), 1.0), 9) AS baseline_retention FROM c""",
    "structural_slots": """WITH c AS (SELECT 'r' || c_nationkey AS review_id, c_mktsegment AS focus_id, c_custkey FROM customer),
        b AS (SELECT review_id, focus_id, c_custkey FROM c WHERE c_custkey % 2 = 0),
        k AS (SELECT review_id, focus_id, 'structural_path' AS slot, 'path' || c_custkey AS target_id FROM b WHERE c_custkey % 10 = 4),
        f AS (SELECT DISTINCT review_id, focus_id FROM c)
        SELECT * FROM k UNION ALL SELECT review_id, focus_id, s.slot, NULL FROM f, (SELECT unnest(['structural_path', 'test_context']) AS slot) s WHERE (review_id, focus_id, s.slot) NOT IN (SELECT (review_id, focus_id, slot) FROM k)""",
    "graph_overview": """WITH n AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal < 2000 THEN ['added', 'modified'][s_suppkey % 2 + 1] WHEN s_suppkey % 3 = 0 THEN 'retained' ELSE 'unresolved' END AS delta,
            CASE WHEN s_acctbal < 2000 THEN 'change' || s_suppkey ELSE 's' || s_suppkey || ':head' END AS shown FROM supplier)
        SELECT 's' || s_suppkey AS id, delta AS state, shown FROM n
        UNION ALL SELECT 'src/n' || s_nationkey, CASE WHEN bool_or(delta IN ('added', 'modified')) THEN 'changed' WHEN bool_or(n_regionkey = 1) THEN 'bridge' ELSE 'context' END, NULL FROM n JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey""",
    "component_groups": """WITH g AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey),
        e AS (SELECT a, b, n_regionkey AS component, count(*) AS ends FROM g JOIN nation ON n_nationkey IN (a, b) GROUP BY ALL)
        SELECT component, count(*) FILTER (WHERE ends >= 2) AS n_internal, count(*) FILTER (WHERE ends = 1) AS n_boundary FROM e GROUP BY component""",
    "focus_coverage": """WITH d AS (SELECT o_custkey, c_nationkey, c_acctbal, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n, bool_or(o_orderkey % 3 = 0 AND o_orderstatus = 'P') AS cut, bool_or(o_orderkey % 3 = 0 AND o_orderstatus <> 'P' AND o_totalprice > 450000) AS unk
            FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_nationkey, c_acctbal)
        SELECT 'r' || c_nationkey AS review_id, 'c' || o_custkey AS focus_id, CASE WHEN c_acctbal < -800 THEN 'reference unresolved' WHEN o_custkey % 9 = 0 THEN 'not required for empty reference'
        WHEN c_nationkey % 3 = 2 THEN 'unknown · exact seed mapping unavailable' WHEN n = 0 THEN 'unknown · no admitted direct seed' WHEN cut THEN 'limited · admitted seed truncated'
        WHEN unk THEN 'unknown · admitted seed state unavailable' ELSE 'complete for admitted direct seeds' END AS coverage FROM d""",
    "owned_diagnostics": f"""WITH r AS (SELECT event_id AS id, 'f' || user_id AS focus_id, {_pick("event_id", "focus", "review", "focus")} AS scope, event_type, strftime(ts, '%d %H') AS slot, {_pick("event_id", "stale", "not_applicable", "partial", "empty")} AS state FROM events),
        g AS (SELECT scope, event_type, slot, state, count(DISTINCT focus_id) > 1 AS shared FROM r GROUP BY ALL)
        SELECT id, CASE WHEN state = 'not_applicable' THEN 'hidden' WHEN scope = 'review' OR shared THEN 'review' ELSE 'focus:' || focus_id END AS owner FROM r JOIN g USING (scope, event_type, slot, state)""",
    "focus_anchors": """WITH g AS (SELECT DISTINCT CAST(quality AS BIGINT) AS f, doc_id AS d FROM labels WHERE toxic = 1), x AS (SELECT DISTINCT CAST(quality AS BIGINT) AS f, doc_id AS d FROM labels WHERE doc_id % 3 = 0),
        b AS (SELECT DISTINCT o_orderkey % 2 AS f, doc_id AS d FROM orders JOIN labels ON doc_id = o_custkey)
        SELECT f AS focus_id, d AS fact_id, CASE WHEN g.f IS NOT NULL THEN 'provided_association' WHEN x.f IS NOT NULL THEN 'distinctive_phrase' ELSE 'claim_bridge' END AS association,
        CASE WHEN g.f IS NULL AND b.f IS NOT NULL THEN 'T' || d ELSE '' END AS bridges FROM g FULL JOIN x USING (f, d) FULL JOIN b USING (f, d)""",
    "explicit_references": """SELECT DISTINCT p_partkey, unnest(['R' || p_partkey % 9, 'G' || p_size % 4, 'R' || p_size]) AS referenced FROM part WHERE p_partkey % 3 <> 1""",
    "review_checks": f"""SELECT 'r' || user_id AS review_id, 'check-run:' || event_id AS observation_id, coalesce(nullif({_pick("event_id", "build", "", "test")}, ''), 'check run') AS name, 'check_run' AS kind,
        coalesce({_pick("user_id", "completed", None)}, 'unknown') AS status, coalesce({_pick("event_id", "success", None)}, '') AS conclusion FROM events WHERE event_type <> 'view'
        UNION ALL SELECT 'r' || user_id, 'commit-status:' || event_id, coalesce({_pick("event_id", "ci/x", None)}, 'commit status'), 'commit_status', CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'pending' END,
        coalesce({_pick("event_id", "success", "pending", None)}, '') FROM events WHERE event_type = 'view'""",
    "linked_issues": """WITH n AS (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Title' ELSE 'Issue #' || o_orderkey END AS title, o_orderpriority AS body FROM orders WHERE o_orderkey % 5 <> 0)
        SELECT 'r' || o_custkey AS review_id, 'issue:o/r#' || k AS id, title, 'sha256:' || sha256(title || chr(0) || body) AS revision FROM n
        UNION ALL SELECT 'r' || o_custkey, 'linked_issues_ambiguous', NULL, CAST(count(*) AS VARCHAR) FROM n GROUP BY o_custkey HAVING count(*) > 1""",
    "revision_states": f"""WITH r AS (SELECT c_custkey, {_pick("c_custkey", "base", "head")} AS side, unnest(list_filter([CASE c_custkey % 5 WHEN 0 THEN 'stale_source' WHEN 1 THEN 'provider_unavailable' WHEN 4 THEN 'provider_unavailable' WHEN 2 THEN 'partial_coverage' END,
            CASE WHEN c_custkey % 3 > 0 THEN 'traversal_truncated' END], lambda x: x IS NOT NULL)) AS diagnostic FROM customer),
        s AS (SELECT o_custkey, count(*) AS n_seeds, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_complete, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS n_truncated FROM orders GROUP BY o_custkey)
        SELECT 'r' || c_custkey AS review_id, side, diagnostic, n_seeds, n_complete, n_truncated FROM r LEFT JOIN s ON o_custkey = c_custkey""",
    "anchor_slots": f"""WITH r AS (SELECT l_orderkey, {_pick("l_linenumber", "changed_anchor", "structural_path")} AS slot, {_pick("l_suppkey", "primary", "test_support", "document_support")} AS evidence_role, l_suppkey % 3 AS rr, l_partkey % 7 AS ar,
            {_pick("l_partkey", "provided_association", "explicit_reference", "exact_identifier", "distinctive_phrase", "claim_bridge", "structural_bridge", "current_head")} AS association, CAST(l_quantity AS INT) AS source_ordinal, l_partkey AS target_id FROM lineitem)
        SELECT l_orderkey, slot, evidence_role, association, source_ordinal, target_id FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY slot, rr, ar, source_ordinal, target_id) = 1""",
    "code_excerpts": """WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS a, length(coalesce(role, '')) AS r FROM conversations),
        u AS (SELECT *, greatest(0, least(least(a + r, 300), 1000 - coalesce(sum(least(a + r, 300)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used FROM c),
        k AS (SELECT *, greatest(0, least(a, used - least(r, used // 2))) AS ka FROM u), j AS (SELECT *, greatest(0, least(r, used - ka)) AS kr FROM k)
        SELECT conv_id AS request_id, turn AS ordinal, CAST(ka AS INT) AS n_added, CAST(kr AS INT) AS n_removed, ka <> a OR kr <> r AS truncated FROM j""",
    "review_projection": """WITH p AS (SELECT n_nationkey AS nk, 'r' || n_regionkey AS review_id FROM nation),
        c AS (SELECT review_id, 'c' || c_custkey AS node, 'n' || c_nationkey AS parent, c_acctbal AS b, c_mktsegment AS f FROM customer JOIN p ON nk = c_nationkey),
        s AS (SELECT review_id, 's' || s_suppkey AS node, 'n' || s_nationkey AS parent, s_acctbal AS b, 'BUILDING' AS f FROM supplier JOIN p ON nk = s_nationkey),
        e AS (SELECT DISTINCT c.review_id, c.node AS a, s.node AS z, c.parent AS ap, s.parent AS zp, l_linestatus AS rel FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN c ON c.node = 'c' || o_custkey JOIN s ON s.node = 's' || l_suppkey WHERE c.review_id = s.review_id),
        o AS (SELECT review_id, f, node, CASE WHEN right(node, 1) < '5' THEN 1 ELSE 2 END AS k, parent FROM c WHERE b < -900 UNION ALL SELECT review_id, f, node, 3, parent FROM s WHERE b < -900),
        m AS (SELECT review_id, f, node, min(k) AS k FROM (SELECT review_id, f, node, k FROM o UNION ALL SELECT review_id, f, parent, 3 FROM o) GROUP BY ALL),
        fs AS (SELECT DISTINCT review_id, f FROM c), mc AS (SELECT review_id, f, count(*) AS n FROM m GROUP BY ALL),
        bc AS (SELECT review_id, f, count(*) FILTER (WHERE b > 9000) AS n, bool_or(b > 9900) AS rich FROM c GROUP BY ALL)
        SELECT review_id, 'node' AS kind, node AS id, CASE WHEN b < 0 THEN CASE WHEN node LIKE 'c%' THEN 'modified' ELSE 'added' END WHEN b < 5000 THEN 'retained' ELSE 'unresolved' END AS state FROM (FROM c UNION ALL FROM s)
        UNION ALL SELECT review_id, 'node', 'n' || nk, 'unresolved' FROM p
        UNION ALL SELECT review_id, 'member', f || '|' || node, ['matched', 'suggested', 'context'][k] FROM m
        UNION ALL SELECT review_id, 'group', CASE WHEN ap = zp THEN a || '|' || z ELSE ap || '|' || zp END || '|' || rel, count(*)::VARCHAR FROM e GROUP BY ALL
        UNION ALL SELECT review_id, 'focus', f, CASE WHEN mc.n > 0 THEN 'projected' ELSE 'unassociated' END FROM fs LEFT JOIN mc USING (review_id, f)
        UNION ALL SELECT review_id, 'matrix', f, CASE WHEN rich THEN 'partial' ELSE 'unverified' END || ':' || bc.n || ':' || coalesce(mc.n, 0) FROM fs JOIN bc USING (review_id, f) LEFT JOIN mc USING (review_id, f)
        UNION ALL SELECT e.review_id, 'edge', x.f || '|' || a || '>' || rel || '>' || z, 'inside' FROM e JOIN m x ON x.review_id = e.review_id AND x.node = a JOIN m y ON y.review_id = e.review_id AND y.node = z AND y.f = x.f""",
    "stored_totals": """WITH s AS (SELECT o_orderkey, count(*) AS n, min(o_orderstatus) AS state, CAST(round(min(o_totalprice) * 100) AS BIGINT)::VARCHAR AS cents FROM orders GROUP BY ALL),
        d AS (SELECT l_orderkey, count(*) AS n, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS state, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::VARCHAR AS cents FROM lineitem GROUP BY ALL),
        j AS (SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, s.n AS sn, s.state AS ss, s.cents AS sc, CASE WHEN d.n IS NULL THEN NULL ELSE 1 END AS dn, d.state AS ds, d.cents AS dc FROM s FULL JOIN d ON o_orderkey = l_orderkey)
        SELECT o_orderkey, '*' AS field, sn::VARCHAR AS stored, dn::VARCHAR AS derived FROM j WHERE sn IS DISTINCT FROM dn
        UNION ALL SELECT o_orderkey, 'state', ss, ds FROM j WHERE sn = dn AND ss IS DISTINCT FROM ds
        UNION ALL SELECT o_orderkey, 'cents', sc, dc FROM j WHERE sn = dn AND sc IS DISTINCT FROM dc""",
    "table_digests": """WITH l AS (SELECT l_orderkey, l_linenumber, to_json({'l_linenumber': l_linenumber, 'l_linestatus': l_linestatus, 'l_orderkey': l_orderkey, 'l_partkey': l_partkey, 'l_returnflag': l_returnflag, 'l_suppkey': l_suppkey})::VARCHAR AS line FROM lineitem),
        o AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, line) - 1 AS i, sha256(line) AS h FROM l),
        a AS (SELECT 1 AS level, i // 256 AS node, sha256(string_agg(h, '' ORDER BY i)) AS digest FROM o GROUP BY ALL),
        b AS (SELECT 2 AS level, node // 256 AS node, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM a WHERE (SELECT count(*) FROM a) > 1 GROUP BY ALL),
        c AS (SELECT 3 AS level, node // 256 AS node, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM b WHERE (SELECT count(*) FROM b) > 1 GROUP BY ALL)
        FROM a UNION ALL FROM b UNION ALL FROM c""",
}
