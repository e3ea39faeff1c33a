"""DuckDB text of the fixture views (mirror of ``pressferry.sources.fixtures``).

Used only by the correctness oracle: each oracle query is ``WITH <views>
<body>``, run by DuckDB over the raw testdata tables.
"""

from __future__ import annotations

import re

from pressferry.sources.fixtures import (
    ADMIN_CAPABILITIES,
    NODE_TYPES,
    SYSTEM_ROW,
    VARIABLE_ROWS,
    WP_OPTION_ROWS,
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(_q(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(cols)})"


EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"

VIEWS: dict[str, str] = {
    "users": """
        SELECT CAST(c_custkey + 1 AS BIGINT) AS uid, c_name AS name, md5(c_name) AS pass,
               lower(c_name) || '@example.org' AS mail, CAST(86400 * (c_custkey + 10) AS BIGINT) AS created
        FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey = 0""",
    "node": """
        SELECT CAST(doc_id + 1 AS BIGINT) AS nid, CAST(doc_id + 100001 AS BIGINT) AS vid,
               CAST(CASE WHEN doc_id % 11 = 0 THEN doc_id + 1000000 ELSE doc_id % 100 + 1 END AS BIGINT) AS uid,
               CASE WHEN lang = 'en' THEN 'story' WHEN lang = 'de' THEN 'page'
                    WHEN lang = 'fr' THEN 'forum' ELSE 'blog' END AS type,
               substr(text, 1, 60) AS title,
               CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS status,
               CAST(86400 * (doc_id - 10) + 3600 AS BIGINT) AS created,
               CAST(86400 * doc_id AS BIGINT) AS changed
        FROM documents""",
    "node_revisions": """
        SELECT CAST(doc_id + 100001 AS BIGINT) AS vid, CAST(doc_id + 1 AS BIGINT) AS nid,
               text || ' <img src="/files/' || CAST(doc_id AS VARCHAR) || '.png">' AS body,
               substr(text, 1, 120) AS teaser
        FROM documents
        UNION ALL
        SELECT CAST(doc_id + 900001 AS BIGINT), CAST(doc_id + 1 AS BIGINT), 'old', 'old'
        FROM documents WHERE doc_id % 4 = 0""",
    "node_type": _values(NODE_TYPES, ["type", "name", "description"]) + """
        UNION ALL SELECT 'place_' || lower(n_name), n_name, 'Region ' || CAST(n_regionkey AS VARCHAR) FROM nation""",
    "url_alias": """
        SELECT CAST(page_id + 1 AS BIGINT) AS pid,
               'node/' || CAST(CASE WHEN page_id % 5 = 1 THEN page_id ELSE page_id + 1 END AS VARCHAR) AS src,
               url AS dst
        FROM pages""",
    "vocabulary": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS vid, r_name AS name, 'about ' || r_name AS description
        FROM region""",
    "term_data": """
        SELECT CAST(p_partkey + 1 AS BIGINT) AS tid, CAST(p_size % 5 + 1 AS BIGINT) AS vid,
               CASE WHEN p_partkey % 101 = 7 THEN NULL
                    WHEN p_partkey % 50 = 0 THEN repeat(p_name, 30)
                    WHEN p_partkey % 3 = 0 THEN upper(p_name)
                    WHEN p_partkey % 7 = 0 THEN p_name || ' ' || CAST(p_partkey AS VARCHAR)
                    ELSE p_name END AS name,
               p_type || ' ' || p_brand AS description
        FROM part""",
    "term_node": """
        SELECT CAST(l_orderkey + 1 AS BIGINT) AS nid, CAST(l_partkey + 1 AS BIGINT) AS tid
        FROM lineitem WHERE l_partkey % 13 <> 0""",
    "comments": f"""
        SELECT CAST(event_id + 1 AS BIGINT) AS cid,
               CAST(CASE WHEN event_id % 4 = 0 THEN event_id ELSE 0 END AS BIGINT) AS pid,
               CAST(event_id % 500 + 1 AS BIGINT) AS nid, CAST(user_id * 11 AS BIGINT) AS uid,
               props AS comment, event_type || CAST(user_id AS VARCHAR) AS name,
               event_type || '@example.org' AS mail,
               repeat('http://h.example/' || event_type || '/', CASE WHEN event_id % 10 = 0 THEN 20 ELSE 1 END) AS homepage,
               CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS status,
               CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp"
        FROM events""",
    "variable": """
        SELECT lower(n_name) AS name,
               's:' || CAST(octet_length(encode(n_name)) AS VARCHAR) || ':"' || n_name || '";' AS value
        FROM nation
        UNION ALL """ + _values(VARIABLE_ROWS, ["name", "value"]),
    "system_": _values([SYSTEM_ROW], ["name", "info"]) + """
        UNION ALL
        SELECT 'module_' || CAST(s_suppkey AS VARCHAR),
               'a:2:{s:4:"name";s:' || CAST(octet_length(encode(s_name)) AS VARCHAR) || ':"' || s_name
               || '";s:7:"version";s:7:"6.x-1.0";}'
        FROM supplier""",
    "users_roles": "SELECT uid, CAST(2 AS BIGINT) AS rid FROM users",
    "acc_categories_from_client": "SELECT tid, vid, name FROM term_data WHERE tid % 9 = 0",
    "content_field_teaser": """
        SELECT CAST(doc_id + 100001 AS BIGINT) AS vid, substr(text, 1, 40) AS field_teaser_value
        FROM documents WHERE doc_id % 2 = 0""",
    "content_type_press": """
        SELECT CAST(doc_id + 100001 AS BIGINT) AS vid,
               'http://press.example/' || CAST(doc_id AS VARCHAR) AS field_press_link_url
        FROM documents WHERE doc_id % 3 = 0""",
    "wp_users0": f"""
        SELECT CAST(s_suppkey + 1 AS BIGINT) AS ID, lower(s_name) AS user_login, md5(s_name) AS user_pass,
               s_name AS user_nicename, lower(s_name) || '@example.com' AS user_email,
               {EPOCH} + to_seconds(s_suppkey * 86400) AS user_registered,
               '' AS user_activation_key, CAST(0 AS INTEGER) AS user_status, s_name AS display_name
        FROM supplier WHERE s_suppkey % 10 = 0""",
    "wp_terms0": """
        SELECT CAST(s_suppkey * 7 + 1 AS BIGINT) AS term_id, s_name AS name,
               replace(lower(s_name), ' ', '_') AS slug, CAST(0 AS BIGINT) AS term_group
        FROM supplier""",
    "wp_posts0": f"""
        SELECT CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 ELSE doc_id + 1000000001 END AS BIGINT) AS id,
               CAST(doc_id % 100 + 1 AS BIGINT) AS post_author, {EPOCH} + to_seconds(86400 * doc_id) AS post_date,
               'earlier <img src="/files/' || CAST(doc_id AS VARCHAR) || '.png">' AS post_content,
               'Earlier post ' || CAST(doc_id AS VARCHAR) AS post_title, '' AS post_excerpt,
               'earlier-' || CAST(doc_id AS VARCHAR) AS post_name, {EPOCH} + to_seconds(86400 * (doc_id + 1)) AS post_modified,
               CASE WHEN doc_id % 4 = 0 THEN 'page' WHEN doc_id % 4 = 1 THEN 'post' ELSE 'story' END AS post_type,
               CASE WHEN doc_id % 5 = 0 THEN 'private' ELSE 'publish' END AS post_status,
               '' AS to_ping, '' AS pinged, '' AS post_content_filtered, CAST(doc_id % 3 AS BIGINT) AS comment_count
        FROM documents WHERE doc_id % 3 = 0""",
    "wp_comments0": f"""
        SELECT CAST(CASE WHEN event_id % 40 = 0 THEN event_id + 1 ELSE event_id + 1000000001 END AS BIGINT) AS comment_ID,
               CAST(event_id % 500 + 1 AS BIGINT) AS comment_post_ID, {EPOCH} + to_seconds(event_id * 60) AS comment_date,
               'earlier comment ' || CAST(event_id AS VARCHAR) AS comment_content, CAST(0 AS BIGINT) AS comment_parent,
               'earlier' AS comment_author, 'earlier@example.org' AS comment_author_email, '' AS comment_author_url,
               '1' AS comment_approved
        FROM events WHERE event_id % 20 = 0""",
    "wp_term_taxonomy0": """
        SELECT CAST(CASE WHEN p_partkey % 20 = 0 THEN p_partkey + 1 ELSE p_partkey + 1000000001 END AS BIGINT) AS term_taxonomy_id,
               CAST(p_partkey + 1 AS BIGINT) AS term_id,
               CASE WHEN p_partkey % 30 = 0 THEN 'category' ELSE 'post_tag' END AS taxonomy,
               'earlier ' || CAST(p_partkey AS VARCHAR) AS description, CAST(0 AS BIGINT) AS parent, CAST(7 AS BIGINT) AS count
        FROM part WHERE p_partkey % 10 = 0""",
    "wp_term_relationships0": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS object_id, CAST(o_custkey + 1000000001 AS BIGINT) AS term_taxonomy_id
        FROM orders WHERE o_orderkey % 10 = 0""",
    "wp_options0": _values(WP_OPTION_ROWS, ["option_name", "option_value"]) + """
        UNION ALL
        SELECT 'wp_widget_' || CAST(s_suppkey AS VARCHAR), s_name FROM supplier""",
    "wp_usermeta0": f"""
        SELECT ID AS user_id, 'wp_capabilities' AS meta_key, {_q(ADMIN_CAPABILITIES)} AS meta_value FROM wp_users0
        UNION ALL SELECT ID, 'wp_user_level', '10' FROM wp_users0
        UNION ALL SELECT ID, 'wp_autosave_draft_ids', 'a:0:{{}}' FROM wp_users0""",
}

# Views that depend on other views must come after them.
ORDER = [
    "users", "node", "node_revisions", "node_type", "url_alias", "vocabulary", "term_data",
    "term_node", "comments", "variable", "system_", "users_roles", "acc_categories_from_client",
    "content_field_teaser", "content_type_press", "wp_users0", "wp_terms0", "wp_options0",
    "wp_usermeta0", "wp_posts0", "wp_comments0", "wp_term_taxonomy0", "wp_term_relationships0",
]

DEPS = {
    "users_roles": ["users"],
    "acc_categories_from_client": ["term_data"],
    "wp_usermeta0": ["wp_users0"],
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def with_views(ctes: list[tuple[str, str]], body: str) -> str:
    """``WITH`` the fixture views a query needs, then its own CTEs, then body."""
    text = body + " " + " ".join(sql for _, sql in ctes)
    words = set(_WORD.findall(text))
    needed: set[str] = set()

    def add(name: str) -> None:
        if name in needed:
            return
        needed.add(name)
        for dep in DEPS.get(name, []):
            add(dep)

    for name in ORDER:
        if name in words:
            add(name)
    parts = [f"{name} AS ({VIEWS[name]})" for name in ORDER if name in needed]
    parts += [f"{name} AS ({sql})" for name, sql in ctes]
    if not parts:
        return body
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
