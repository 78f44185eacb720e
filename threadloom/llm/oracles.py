"""DuckDB SQL of those queries that SQL can express.

Not among them: op1 and op7 need CRC-32 and Spark's hash, op4 and op5 a tokenizer, op10 trained vectors, op11 trained
dictionaries; tests hold these against plain code.
"""

from __future__ import annotations

from . import url_filters as U

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * c >= 85 * (len(sa.sh) + len(sb.sh) - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.id = s.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS g FROM i),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS at FROM g JOIN f USING (g) WHERE least < doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS at FROM w),
t AS (SELECT k.doc_id, string_agg(ws[k.at], ' ' ORDER BY k.at) AS kept FROM k LEFT JOIN gone ON gone.doc_id = k.doc_id AND gone.at = k.at WHERE gone.at IS NULL GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""

_ESCAPED = "(2 * length({0}) - length(regexp_replace({0}, '[\\\\<>\\[\\]]', '', 'g')))"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(14 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_rejected
FROM c GROUP BY conv_id
"""

_PLAIN_WORD = r"'[^\x20\x09-\x0D!-/:-@\[-`{-~]+'"
_SHINGLES = "SELECT DISTINCT {0}, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM (SELECT {0}, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM {1} WHERE len(ws) >= k)"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN_WORD}) AS ws FROM documents),
b AS (SELECT item_id, ws, least(5, len(ws)) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_PLAIN_WORD}) AS ws FROM benchmark) WHERE len(ws) > 0),
bs AS ({_SHINGLES.format('item_id', 'b')}), n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
dk AS (SELECT doc_id, ws, k FROM d, (SELECT DISTINCT k FROM b)), ds AS ({_SHINGLES.format('doc_id', 'dk')}),
c AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN bs USING (k, g) GROUP BY 1, 2)
SELECT doc_id, item_id, c AS n_shared, n AS n_item, c / n::DOUBLE AS containment FROM c JOIN n USING (item_id) WHERE 100 * c >= 80 * n
"""


def url_filter_sql() -> str:
    host = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}} END" for h, p, _ in U.RULES]
    longest = sorted(range(len(U.RULES)), key=lambda k: -len(U.RULES[k][0] + U.RULES[k][1]))
    rule = "coalesce(" + ", ".join(fits[k].format(f"'{U.RULES[k][0]}{U.RULES[k][1]}'") for k in longest) + ")"
    ruled = "coalesce(" + ", ".join(fits[k].format(f"'{U.RULES[k][2]}'") for k in longest) + ")"
    form = "CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '<n>' WHEN regexp_matches(x, '^[0-9a-fA-F-]{8,}$') THEN '<x>' WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') THEN '<w>' ELSE x END"
    domain = "array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.')"
    prefix = "array_to_string(list_slice(p, 1, {0}), '/')"
    parts = [
        "r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, {host} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r)",
        f"s AS (SELECT *, {rule} AS rule, {ruled} AS ruled, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {form}) AS form FROM h)",
        "p AS (SELECT *, CASE ruled WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad FROM s)",
        f"""t AS (SELECT host, form, count(bad) AS labels, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad, 0 AS k, '' AS template, len(form) > 0 AS live FROM p GROUP BY host, form
            UNION ALL SELECT host, form, labels, bad, k + 1, template || '/' || CASE WHEN forms < {U.MANY_CHILDREN} THEN array_to_string(list_slice(form, k + 1, len(form)), '/')
                WHEN children >= {U.MANY_CHILDREN} AND forms < children * {U.FORMS_A_CHILD} THEN '<*>' ELSE form[k + 1] END, forms >= {U.MANY_CHILDREN} AND len(form) > k + 1
            FROM (SELECT *, count(*) OVER (PARTITION BY host, template) AS forms, count(DISTINCT form[k + 1]) OVER (PARTITION BY host, template) AS children FROM t WHERE live))""",
        "tree AS (SELECT host, form, labels, bad, template, list_filter(string_split(template, '/'), lambda x: x <> '') AS p FROM t WHERE NOT live)",
        "leaf AS (SELECT host, template, p, CAST(sum(labels) AS BIGINT) AS labels, CAST(sum(bad) AS BIGINT) AS bad FROM tree GROUP BY ALL)",
        f"e AS (SELECT *, {prefix.format('j')} AS node, {prefix.format('j - 1')} AS above, p[j] AS segment FROM (SELECT *, unnest(range(1, len(p) + 1)) AS j FROM leaf))",
        f"n AS (SELECT host, j, above, node, sum(labels) AS n, sum(bad) AS b FROM e GROUP BY ALL HAVING sum(labels) >= {U.LABELS})",
        "pool AS (SELECT host, j, above, sum(b) / sum(n)::DOUBLE AS rate FROM n GROUP BY ALL HAVING count(*) > 1)",
        f"same AS (SELECT host, j, node FROM n JOIN pool USING (host, j, above) WHERE abs(b / n::DOUBLE - rate) <= {U.Z} * sqrt(rate * (1 - rate) / n) + 1e-12)",
        "nb AS (SELECT e.host, e.template, string_agg('/' || CASE WHEN same.node IS NULL THEN segment ELSE '<~>' END, '' ORDER BY e.j) AS branch FROM e LEFT JOIN same ON same.host = e.host AND same.j = e.j AND same.node = e.node GROUP BY ALL)",
        "nl AS (SELECT leaf.host, leaf.template, labels, bad, coalesce(branch, '') AS branch FROM leaf LEFT JOIN nb ON nb.host = leaf.host AND nb.template = leaf.template)",
        "br AS (SELECT host, branch, list_filter(string_split(branch, '/'), lambda x: x <> '') AS p, CAST(sum(labels) AS BIGINT) AS labels, CAST(sum(bad) AS BIGINT) AS bad FROM nl GROUP BY ALL)",
        "prior AS (SELECT coalesce(sum(bad) / nullif(sum(labels), 0)::DOUBLE, 0.0) AS prior FROM br)",
        f"""sc AS (SELECT host, branch, labels, bad, 0 AS level, '*' AS owner, branch AS node FROM br UNION ALL SELECT host, branch, labels, bad, 1, {domain}, '' FROM br UNION ALL SELECT host, branch, labels, bad, 2, {domain}, branch FROM br
            UNION ALL SELECT host, branch, labels, bad, j + 3, host, {prefix.format('j')} FROM (SELECT *, unnest(range(0, len(p) + 1)) AS j FROM br))""",
        "sums AS (SELECT level, owner, node, sum(CASE level WHEN 0 THEN least(labels, 1) ELSE labels END) AS n, sum(CASE level WHEN 0 THEN coalesce(bad / nullif(labels, 0)::DOUBLE, 0) ELSE bad END) AS b FROM sc GROUP BY ALL)",
        "steps AS (SELECT host, branch, level, n, b FROM sc JOIN sums USING (level, owner, node))",
        f"""f AS (SELECT host, branch, -1 AS level, (SELECT prior FROM prior) AS share FROM br UNION ALL
            SELECT f.host, f.branch, f.level + 1, (b + {U.WEIGHT} * share) / (n + {U.WEIGHT})::DOUBLE FROM f JOIN steps ON steps.host = f.host AND steps.branch = f.branch AND steps.level = f.level + 1)""",
        "q AS (SELECT host, branch, round(arg_max(share, level), 9) AS purity FROM f GROUP BY ALL)",
        "k AS (SELECT tree.host, tree.form, tree.template, nl.branch, purity FROM tree JOIN nl ON nl.host = tree.host AND nl.template = tree.template JOIN q ON q.host = nl.host AND q.branch = nl.branch)",
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + f""" SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN purity >= {U.PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, branch, round(purity, 6) AS purity
        FROM p JOIN k ON k.host = p.host AND k.form = p.form"""
    )


_TOKEN = r"'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'"
_DRAW = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"
FILL_IN_MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, {_TOKEN}) AS ts FROM d),
c AS (SELECT *, len(ts) AS n, {_DRAW.format(1)} % (len(ts) + 1) AS x, {_DRAW.format(9)} % (len(ts) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_DRAW.format(17)} % 100 >= 50 THEN 'plain'
        WHEN {_DRAW.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(list_slice(ts, 1, least(x, y)), '') AS prefix, array_to_string(list_slice(ts, least(x, y) + 1, greatest(x, y)), '') AS middle,
    array_to_string(list_slice(ts, greatest(x, y) + 1, n), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""


def clustering_sql() -> str:
    """Lloyd's rounds over (id, position, value) rows; ``d`` tells rows of one id apart."""
    parts = [
        "r AS (SELECT row_number() OVER () AS d, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "v AS (SELECT d, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM r)",
        "x AS (SELECT d, unnest(range(64)) AS i, unnest(v) AS a FROM v)",
        "s0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM v QUALIFY c < 16)",
        "c0 AS (SELECT c, unnest(range(64)) AS i, unnest(v) AS a FROM s0)",
    ]
    for k in range(4):
        parts.append(f"a{k} AS (SELECT d, min(struct_pack(far, c)) AS near FROM (SELECT d, c, CAST(sum((x.a - c{k}.a) * (x.a - c{k}.a)) AS BIGINT) AS far FROM x JOIN c{k} USING (i) GROUP BY d, c) GROUP BY d)")
        if k < 3:
            parts.append(f"m{k} AS (SELECT near.c AS c, i, CAST(sum(a) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (d) GROUP BY ALL)")
            parts.append(f"c{k + 1} AS (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, a) AS a FROM c{k} LEFT JOIN m{k} USING (c, i))")
    parts.append("h AS (SELECT c, sha256(string_agg(CAST(a AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)")
    return (
        "WITH " + ",\n".join(parts) + """ SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, near.far AS distance, CAST(sum(near.far) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(near.far) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a3 JOIN v USING (d) JOIN h ON h.c = near.c"""
    )


ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op3_fm_index_substring_dedup": SUBSTRING_DEDUP,
    "op6_path_template_url_filters": url_filter_sql(),
    "op8_schema_fingerprint_chat": CHAT,
    "op9_benchmark_decontamination": DECONTAMINATION,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op13_annulus_clustering": clustering_sql(),
}
