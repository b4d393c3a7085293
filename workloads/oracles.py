"""The SQL that says what each query of `queries.py` must return, in DuckDB's dialect."""

from __future__ import annotations

WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def timing(begin: str, end: str) -> str:
    shown = lambda x: f"strftime({x}, '%d/%m/%Y à %Hh%M')"
    return f"""CASE WHEN {begin} IS NOT NULL AND {end} IS NOT NULL THEN 'Du ' || {shown(begin)} || ' au ' || {shown(end)}
        WHEN {begin} IS NOT NULL THEN 'À partir du ' || {shown(begin)}
        WHEN {end} IS NOT NULL THEN 'Jusqu''au ' || {shown(end)} END"""


def status_timing(shift: int) -> str:
    moment = f"o_orderdate + INTERVAL {shift} MINUTE"
    begin = f"(CASE WHEN o_orderstatus <> 'P' THEN {moment} END)"
    end = f"(CASE WHEN o_orderstatus <> 'F' THEN {moment} + INTERVAL 2 HOUR END)"
    return timing(begin, end)


STATUS_CASE = """CASE {0} WHEN 1 THEN 'Programmé' WHEN 2 THEN 'Reprogrammé' WHEN 3 THEN 'Déplacé en ligne'
    WHEN 4 THEN 'Reporté' WHEN 5 THEN 'Complet' WHEN 6 THEN 'Annulé' END"""
MODE_CASE = "CASE {0} WHEN 1 THEN 'Présentiel' WHEN 2 THEN 'En ligne' WHEN 3 THEN 'Hybride' END"

IMPORTED = """
    turns AS (
        SELECT conv_id || '-' || turn AS u, * FROM conversations
        WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 7)),
    imported AS (
        SELECT u AS uid, role AS title, text AS description, conv_id, turn, 0 AS pos FROM turns WHERE role <> 'system'
        UNION ALL
        SELECT u || 'b', 'reply', text, conv_id, turn, 1 FROM turns WHERE role = 'assistant'),
    tagged AS (
        SELECT uid, title, description, CAST(conv_id AS VARCHAR) AS agenda_uid,
            CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_name ELSE 'Sans titre' END AS agenda_title,
            c_custkey * 1048576 AS ingest_agenda, turn AS ingest_page, pos AS ingest_pos
        FROM imported JOIN customer ON c_custkey = conv_id)"""

CHAINS = """
    chains AS (
        SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND max(turn) >= 1 THEN 1 WHEN conv_id % 3 = 1 AND max(turn) > 0 THEN max(turn) END AS lost
        FROM conversations GROUP BY conv_id)"""

HOLEY = """
    holey AS (
        SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS o_orderstatus,
            CASE WHEN o_totalprice > 495000 THEN o_totalprice END AS o_totalprice,
            CAST(NULL AS VARCHAR) AS o_comment, o_orderpriority
        FROM orders)"""

KEYLESS = """
    lines AS (
        SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate, l_orderkey || '-' || l_linenumber AS line,
            CASE WHEN l_orderkey % 3 <> 0 THEN l_orderkey END AS uid
        FROM lineitem GROUP BY l_orderkey, l_linenumber),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey * 100 + l_linenumber) AS r FROM lines)"""

LOCATIONS = """
    loc AS (
        SELECT *, CASE WHEN c_acctbal > 3000 THEN 'chez ' || c_name ELSE n_name END AS french,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 'plain text'
                 WHEN c_acctbal > 3000 THEN 'chez ' || c_name ELSE n_name END AS described
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CHUNKS = f"""
    windows AS (
        SELECT doc_id, text, unnest(generate_series(0, CASE WHEN length(text) <= 1000 THEN 0
            ELSE CAST(ceil((length(text) - 1000) / 850.0) AS BIGINT) END)) AS w FROM documents),
    pieces AS (
        SELECT doc_id, w, {strip("substring(text, w * 850 + 1, 1000)")} AS chunk_text FROM windows),
    chunk AS (
        SELECT doc_id AS uid, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1 AS INTEGER) AS chunk_index, chunk_text
        FROM pieces WHERE chunk_text <> '')"""

UNIT = """
    cells AS (
        SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM cells GROUP BY vec_id),
    unit AS (
        SELECT vec_id, any_value(label) AS label, list(CAST(CAST(x / n AS FLOAT) AS DOUBLE) ORDER BY i) AS v
        FROM cells JOIN norms USING (vec_id) GROUP BY vec_id),
    means AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i),
    mean_norms AS (SELECT label, sqrt(sum(x * x)) AS n FROM means GROUP BY label),
    asked AS (
        SELECT label AS query_id, list(CAST(CAST(x / n AS FLOAT) AS DOUBLE) ORDER BY i) AS q
        FROM means JOIN mean_norms USING (label) GROUP BY label),
    scored AS (
        SELECT query_id, vec_id AS chunk_id, label AS uid, CAST(list_inner_product(q, v) AS FLOAT) AS score
        FROM unit CROSS JOIN asked)"""

TOP_EVENTS = """
    fetched AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored QUALIFY r <= 15),
    once AS (
        SELECT *, row_number() OVER (PARTITION BY query_id, uid ORDER BY r) AS n FROM fetched QUALIFY n = 1),
    top AS (
        SELECT query_id, chunk_id, uid, score,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank
        FROM once QUALIFY rank <= 5)"""

EMBEDDED = """
    texts AS (
            SELECT 'c' AS side, uid || '_' || chunk_index AS id, chunk_text AS t FROM chunk
            UNION ALL SELECT 'q', CAST(item_id AS VARCHAR), text FROM benchmark),
        tokens AS (
            SELECT side, id, unnest(regexp_split_to_array(lower(t), '[ \\t-\\r]+')) AS token FROM texts),
        slots AS (
            SELECT side, id, CAST('0x' || substring(md5(token), 1, 7) AS BIGINT) % 64 AS slot, count(*) AS n
            FROM tokens WHERE token <> '' GROUP BY 1, 2, 3),
        lengths AS (SELECT side, id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS len FROM slots GROUP BY 1, 2),
        weights AS (
            SELECT side, id, slot, CAST(CAST(n / len AS FLOAT) AS DOUBLE) AS x FROM slots JOIN lengths USING (side, id)),
        products AS (
            SELECT CAST(q.id AS BIGINT) AS query_id, c.id AS chunk_id, sum(q.x * c.x) AS s
            FROM weights q JOIN weights c ON q.side = 'q' AND c.side = 'c' AND q.slot = c.slot GROUP BY 1, 2),
        scored AS (
            SELECT query_id, chunk_id, CAST(split_part(chunk_id, '_', 1) AS BIGINT) AS uid, CAST(s AS FLOAT) AS score FROM products)"""

RESULTS = f"""WITH {UNIT}, {TOP_EVENTS},
    shown AS (
        SELECT query_id, rank, 'Titre : n ' || doc_id
            || CASE WHEN {strip("text")} <> '' THEN chr(10) || 'Description : ' || text ELSE '' END
            || CASE WHEN lang = 'fr' THEN chr(10) || 'Conditions : ' || source ELSE '' END
            || chr(10) || 'Statut : ' || lang AS block
        FROM top JOIN documents ON doc_id = chunk_id),
    contexts AS (
        SELECT query_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
            CAST(count(*) AS INTEGER) AS n_events
        FROM shown GROUP BY query_id)"""

LINES = f"""{IMPORTED},
    lines AS (
        SELECT uid, title, length('Titre : ' || title || CASE WHEN {strip("description")} <> '' THEN chr(10) || 'Description : ' || d ELSE '' END) AS n FROM (
            SELECT *, nullif({strip("regexp_replace(regexp_replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '[-_]{{3,}}', ' ', 'g'), '[ \\t-\\r]+', ' ', 'g')")}, '') AS d FROM tagged)),
    parts AS (SELECT *, CAST(CASE WHEN n <= 1000 THEN 1 ELSE ceil((n - 1000) / 850.0) + 1 END AS BIGINT) AS chunks FROM lines)"""

ORACLES = {
    "explode_pages": f"WITH {IMPORTED} SELECT * FROM tagged",
    "rejected_agendas": """
        SELECT CAST(conv_id AS VARCHAR) AS agenda_uid, count(*) AS bad_pages FROM conversations WHERE turn = 7 GROUP BY 1""",
    "incomplete_agendas": f"""WITH {CHAINS}
        SELECT CAST(conv_id AS VARCHAR) AS agenda_uid, CAST(0 AS BIGINT) AS bad_pages, CAST(1 AS BIGINT) AS missing_pages,
            CAST(lost AS BIGINT) AS first_missing_page, 'a page that a cursor points to is missing' AS reason
        FROM chains JOIN customer ON c_custkey = conv_id WHERE lost IS NOT NULL""",
    "complete_agendas": f"""WITH {CHAINS}
        SELECT DISTINCT conv_id || '-' || turn AS uid, CAST(conv_id AS VARCHAR) AS agenda_uid, CAST(turn AS BIGINT) AS ingest_page
        FROM conversations JOIN chains USING (conv_id) JOIN customer ON c_custkey = conv_id WHERE lost IS NULL""",
    "chosen_language": """
        WITH t AS (
            SELECT *, c_custkey % 6 AS n, CASE c_custkey % 6 WHEN 2 THEN c_name WHEN 4 THEN '{"label":"x"}' WHEN 5 THEN NULL ELSE c_name END AS shown
            FROM customer)
        SELECT CAST(c_custkey AS VARCHAR) AS uid, shown AS title, shown AS description, shown AS conditions,
            CASE n WHEN 0 THEN 'a, b' WHEN 1 THEN 'halle' WHEN 2 THEN 'solo' ELSE 'x' END AS keywords
        FROM t""",
    "tag_agenda": """
        SELECT o_orderkey AS uid, o_custkey AS agenda_uid,
            CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Sans titre' ELSE c_name END AS agenda_title
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "limit_agendas": """
        SELECT o_orderkey AS uid, o_custkey AS agenda_uid FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20)""",
    "recent_filter": """
        SELECT o_orderkey AS uid, o_orderpriority AS title FROM orders
        WHERE o_orderdate >= DATE '1999-03-15' AND o_orderpriority = '2-HIGH'""",
    "stale_check": """
        SELECT o_orderkey AS uid, o_orderpriority AS title,
            strftime(o_orderdate + INTERVAL 26 HOUR, '%Y-%m-%dT%H:%M:%S') AS last_end
        FROM orders WHERE o_orderstatus <> 'P' AND CAST(o_orderdate + INTERVAL 26 HOUR AS DATE) < DATE '1999-03-15'""",
    "json_records": """
        SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","nation":'
            || CASE WHEN c_nationkey > 4 THEN CAST(c_nationkey AS VARCHAR) ELSE 'null' END || '}' AS value FROM customer""",
    "normalise_missing": """
        SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_name END AS p_name, CASE WHEN p_size <= 45 THEN p_type END AS p_type,
            CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size,
            CASE WHEN p_size >= 20 THEN p_retailprice END AS p_retailprice,
            CASE WHEN p_size >= 30 THEN p_brand END AS brands
        FROM part""",
    "comparison_key": """
        SELECT event_id, replace(props, ' ', '') AS props_key,
            '{"event_type":"' || event_type || '","user_id":' || CASE WHEN value > 10 THEN CAST(user_id AS VARCHAR) ELSE 'null' END || '}' AS pair_key,
            event_type AS type_key
        FROM events""",
    "merge_scalar": """
        SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type,
            arg_max(value, ts) FILTER (event_type <> 'error') AS value
        FROM events GROUP BY user_id""",
    "merge_list": """
        WITH items AS (
            SELECT user_id, ts, event_type AS item, 0 AS i FROM events UNION ALL SELECT user_id, ts, props, 1 FROM events),
        first_sight AS (
            SELECT user_id, item, max(ts) AS ts, arg_max(i, ts) AS i FROM items GROUP BY user_id, item)
        SELECT user_id, string_agg(item, '|' ORDER BY ts DESC, i) AS items FROM first_sight GROUP BY user_id""",
    "merge_dict": """
        WITH latest AS (
            SELECT user_id, event_type, min(ts) AS seen, arg_max(value, ts) AS value FROM events
            WHERE event_type <> 'error' GROUP BY user_id, event_type)
        SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seen) - 1 AS INTEGER) AS place, event_type, value FROM latest""",
    "merge_struct": """
        SELECT user_id, arg_max(value, ts) FILTER (event_type <> 'error') AS value,
            arg_max(props, ts) FILTER (event_type = 'signup') AS props, CAST(NULL AS VARCHAR) AS never
        FROM events GROUP BY user_id""",
    "merge_sources": """
        WITH s AS (SELECT text, source, max(doc_id) AS seen FROM documents GROUP BY text, source),
        l AS (SELECT text, lang, max(doc_id) AS seen FROM documents GROUP BY text, lang)
        SELECT text, (SELECT max(doc_id) FROM documents d WHERE d.text = a.text) AS doc_id, sources, langs
        FROM (SELECT text, string_agg(source, ',' ORDER BY seen DESC) AS sources FROM s GROUP BY text) a
        JOIN (SELECT text, string_agg(lang, ', ' ORDER BY seen DESC) AS langs FROM l GROUP BY text) b USING (text)""",
    "merge_hot_key": f"""WITH {KEYLESS},
        listed AS (SELECT uid, count(*) * 2 AS n_items, md5(string_agg(line || '|' || line || 'b', '|' ORDER BY r)) AS items_md5 FROM ranked GROUP BY uid),
        seen AS (SELECT uid, l_linenumber, max(r) AS oldest FROM ranked GROUP BY 1, 2),
        keys AS (SELECT uid, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY oldest DESC) AS entry_order FROM seen GROUP BY uid)
        SELECT l.uid, CAST(n_items AS INTEGER) AS n_items, items_md5, entry_order FROM listed l JOIN keys k ON l.uid IS NOT DISTINCT FROM k.uid""",
    "keyless_apart": f"""WITH {KEYLESS}
        SELECT 'merged' AS kind, uid, string_agg(line || '|' || line || 'b', '|' ORDER BY r) AS items FROM ranked WHERE uid IS NOT NULL GROUP BY uid
        UNION ALL SELECT 'keyless', NULL, line || '|' || line || 'b' FROM ranked WHERE uid IS NULL""",
    "clean_text": f"""
        SELECT page_id, nullif({strip("regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[-_]{3,}', ' ', 'g'), '[ \\t-\\r]+', ' ', 'g')")}, '') AS body
        FROM pages""",
    "join_list": f"""
        WITH words AS (
            SELECT doc_id, {strip("word")} AS word, i FROM (
                SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)),
        firsts AS (
            SELECT doc_id, word, min(i) AS i FROM words WHERE lower(word) NOT IN ('', 'missing value') GROUP BY doc_id, word)
        SELECT doc_id, w.words FROM documents LEFT JOIN (
            SELECT doc_id, string_agg(word, ', ' ORDER BY i) AS words FROM firsts GROUP BY doc_id) w USING (doc_id)""",
    "format_datetime": """
        SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%d/%m/%Y à %Hh%M') END AS shown,
            CASE WHEN o_orderstatus <> 'F' THEN CAST(epoch(o_orderdate + INTERVAL 5 HOUR) AS BIGINT) END AS utc_seconds
        FROM orders""",
    "format_timing": f"SELECT o_orderkey, {status_timing(75)} AS shown FROM orders",
    "format_all_timings": f"""
        SELECT o_orderkey, nullif(concat_ws(' | ', {status_timing(0)}, {status_timing(1441)}), '') AS shown FROM orders""",
    "map_codes": f"""
        SELECT {STATUS_CASE.format("l_linenumber")} AS status, {MODE_CASE.format("l_linenumber")} AS mode_participation, count(*) AS n
        FROM lineitem GROUP BY 1, 2""",
    "format_accessibility": """
        SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN coalesce(nullif(concat_ws(', ',
            CASE WHEN c_acctbal > 5000 THEN 'handicap moteur' END, CASE WHEN c_acctbal < 2000 THEN 'handicap auditif' END,
            CASE WHEN c_nationkey < 10 THEN 'handicap visuel' END), ''), 'Aucune information d''accessibilité') END AS shown
        FROM customer""",
    "format_image": """
        SELECT p_partkey, CASE WHEN p_size > 5 THEN 'https://img/' || p_brand || '/' ELSE '' END
            || CASE WHEN p_size > 20 THEN p_type || '.jpg' WHEN p_size < 40 THEN p_name || '.png' END AS url
        FROM part""",
    "format_registration": """
        SELECT c_custkey, concat_ws(' | ', 'Email : ' || c_name || '@x.org',
            upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' : ' || CAST(trunc(c_acctbal) AS BIGINT),
            CASE WHEN c_nationkey <= 5 THEN 'Téléphone : 05 61' END,
            CASE WHEN c_nationkey > 15 THEN 'Contact : ' || c_name END) AS shown
        FROM customer""",
    "format_links": """
        WITH parts AS (
            SELECT conv_id, turn, concat_ws(' | ', 'Lien : https://c/' || conv_id, 'Titre : ' || role,
                CASE WHEN turn <= 1 THEN 'Auteur : A' END, CASE WHEN text <> '' THEN 'Description : ' || text END) AS a,
                CASE WHEN role = 'user' THEN 'Lien : https://u' END AS b FROM conversations)
        SELECT conv_id, turn, concat_ws(' | ', a, b) AS shown, concat_ws(' | ', a, 'Miniature : t.png', b) AS with_thumbnail FROM parts""",
    "localised_text": f"WITH {LOCATIONS} SELECT c_custkey, french, described AS description FROM loc",
    "location_text": f"""WITH {LOCATIONS}
        SELECT c_custkey, concat_ws(' | ', 'Lieu : ' || c_name, CASE WHEN c_nationkey > 3 THEN 'Adresse : ' || n_name END,
            'Description du lieu : ' || described, CASE WHEN c_acctbal >= 1000 THEN 'Téléphone : 05' END,
            'Site web : https://' || r_name, 'Image du lieu : i.png') AS shown FROM loc""",
    "location_fields": f"""WITH {LOCATIONS}
        SELECT c_custkey, c_name AS location_name, CASE WHEN c_nationkey > 3 THEN n_name END AS location_address,
            n_name AS location_city, CAST(c_custkey AS VARCHAR) AS location_postal_code, c_mktsegment AS location_department,
            r_name AS location_region, c_acctbal AS location_latitude, -c_acctbal AS location_longitude FROM loc""",
    "canonical_region": """
        SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Occitanie' ELSE lower(c_mktsegment) END AS region,
            CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'Haute-Garonne' ELSE lower(c_mktsegment) END AS department
        FROM customer""",
    "format_age": """
        SELECT p_partkey, CASE WHEN p_size < 30 AND p_size > 15 THEN 'De ' || (p_size - 1) || ' à ' || (p_size + 10) || ' ans'
            WHEN p_size < 30 THEN 'À partir de ' || (p_size - 1) || ' ans' ELSE 'Jusqu''à ' || (p_size + 10) || ' ans' END AS shown
        FROM part""",
    "clean_event_rows": """
        WITH o AS (
            SELECT *, o_orderstatus AS s, o_orderdate AS d,
                CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS u,
                row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS r
            FROM orders),
        words AS (
            SELECT o_custkey, w, min(r * 2 + i) AS p FROM (
                SELECT o_custkey, r, 0 AS i, o_orderpriority AS w FROM o UNION ALL SELECT o_custkey, r, 1, lower(o_orderpriority) FROM o)
            GROUP BY 1, 2),
        kw AS (SELECT o_custkey, string_agg(w, ', ' ORDER BY p) AS keywords FROM words GROUP BY 1),
        days AS (SELECT o_custkey, d, min(r) AS p FROM o GROUP BY 1, 2),
        tm AS (SELECT o_custkey, string_agg('À partir du ' || strftime(d, '%d/%m/%Y à %Hh%M'), ' | ' ORDER BY p) AS timings FROM days GROUP BY 1),
        agendas AS (SELECT o_custkey, s, min(r) AS p FROM o GROUP BY 1, 2),
        ag AS (SELECT o_custkey, string_agg(s, ',' ORDER BY p) AS agenda_uids, string_agg('Agenda ' || s, ', ' ORDER BY p) AS agenda_titles FROM agendas GROUP BY 1),
        plain AS (
            SELECT o_custkey, arg_min(o_orderpriority, r) AS title,
                arg_min(o_orderkey || ' *fin*', r) FILTER (s <> 'F') AS description,
                CAST(epoch(max(u)) AS BIGINT) AS updatedAt,
                arg_min('https://i/' || o_orderkey, r) FILTER (s = 'O') AS image,
                arg_min(CASE WHEN s = 'F' THEN 1 ELSE 9 END, r) FILTER (s <> 'P') AS mode,
                arg_min('Salle ' || o_orderkey, r) FILTER (s <> 'P') AS name,
                arg_min(CAST(trunc(o_totalprice) AS BIGINT), r) FILTER (s = 'P') AS low,
                arg_min(s = 'F', r) AS hi, arg_min(s = 'O', r) AS vi
            FROM o GROUP BY 1)
        SELECT CAST(o_custkey AS VARCHAR) AS uid, title, description, keywords, updatedAt, timings, image,
            CASE WHEN mode = 1 THEN 'Présentiel' END AS mode_participation, 'Complet' AS status,
            'À partir de ' || low || ' ans' AS age,
            CASE WHEN hi THEN 'handicap auditif' WHEN vi THEN 'handicap visuel' ELSE 'Aucune information d''accessibilité' END AS accessibility_text,
            agenda_uids, agenda_titles, name AS location_name,
            CAST(NULL AS VARCHAR) AS location_address, CAST(NULL AS VARCHAR) AS location_city, CAST(NULL AS VARCHAR) AS location_postal_code,
            CAST(NULL AS VARCHAR) AS location_department, 'Occitanie' AS location_region,
            CAST(NULL AS DOUBLE) AS location_latitude, CAST(NULL AS DOUBLE) AS location_longitude,
            CASE WHEN name IS NOT NULL THEN 'Lieu : ' || name END AS location_text
        FROM plain JOIN kw USING (o_custkey) JOIN tm USING (o_custkey) JOIN ag USING (o_custkey)""",
    "clean_all_columns": """
        WITH o AS (
            SELECT *, CAST(o_orderkey AS VARCHAR) AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso,
                strftime(o_orderdate, '%d/%m/%Y à %Hh%M') AS day FROM orders)
        SELECT k AS uid, o_orderpriority AS title, 'd ' || k AS description, 'L ' || k AS "longDescription",
            '[solo] ' || o_orderstatus AS keywords, '1 - 2 juin' AS "dateRange", iso AS "createdAt",
            CAST(epoch(o_orderdate) AS BIGINT) AS "updatedAt", 'Du ' || day || ' au ' || day AS timings,
            'À partir du ' || day AS "firstTiming", 'Jusqu''au ' || day AS "lastTiming", 'Du ' || day || ' au ' || day AS "nextTiming",
            'https://i/' || k || '-full.jpg' AS image, 'Présentiel' AS mode_participation, 'Complet' AS status,
            'Téléphone : ' || k || ' | Abc : v' AS registration, 'De 3 à 9 ans' AS age, 'handicap auditif' AS accessibility_text,
            'Gratuit' AS conditions, 'https://b/' || k AS billetterie,
            'Lien : https://l | Titre : T | Auteur : A | Lien : https://k' AS links,
            o_orderstatus AS agenda_uids, 'Agenda ' || o_orderstatus AS agenda_titles, 'Salle' AS location_name, '1 rue' AS location_address,
            'Castres' AS location_city, '31000' AS location_postal_code, 'Haute-Garonne' AS location_department, 'Occitanie' AS location_region,
            CAST(43.5 AS DOUBLE) AS location_latitude, CAST(1 AS DOUBLE) AS location_longitude,
            'Lieu : Salle | Adresse : 1 rue | Description du lieu : Halle | Accès : {Métro | Téléphone : 05 | Email : e@e | Site web : https://s | Image du lieu : i.png' AS location_text
        FROM o""",
    "drop_constants": "SELECT c_custkey, c_name, c_mktsegment, 'kept' AS title FROM customer",
    "drop_sparse": f"""WITH {HOLEY} SELECT o_orderkey, o_orderstatus, o_orderpriority FROM holey""",
    "project_columns": "SELECT c_mktsegment AS mode_participation, c_custkey, c_name FROM customer",
    "profile_duplicates": """
        WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
        SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys,
            CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_duplicated_keys, count(*) FILTER (n > 1) AS duplicated_keys
        FROM k""",
    "profile_conflicts": """
        WITH k AS (
            SELECT count(DISTINCT l_partkey) > 1 AS l_partkey, count(DISTINCT l_suppkey) > 1 AS l_suppkey,
                count(DISTINCT l_quantity) > 1 AS l_quantity, count(DISTINCT l_extendedprice) > 1 AS l_extendedprice,
                count(DISTINCT l_discount) > 1 AS l_discount, count(DISTINCT l_tax) > 1 AS l_tax,
                count(DISTINCT nullif(l_returnflag, 'A')) > 1 AS l_returnflag, count(DISTINCT l_linestatus) > 1 AS l_linestatus,
                count(DISTINCT l_shipdate) > 1 AS l_shipdate
            FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1),
        u AS (UNPIVOT k ON COLUMNS(*) INTO NAME "column" VALUE conflict)
        SELECT "column", count(*) FILTER (conflict) AS conflicting_keys,
            round(count(*) FILTER (conflict) * 100.0 / count(*), 2) AS conflicting_pct
        FROM u GROUP BY 1""",
    "profile_nulls": f"""WITH {HOLEY},
        n AS (SELECT count(*) AS o_all, count(o_orderkey) AS a, count(o_orderstatus) AS b, count(o_totalprice) AS c, count(o_comment) AS d, count(o_orderpriority) AS e FROM holey)
        SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_comment', 'o_orderpriority']) AS "column",
            unnest([round(CAST(o_all - x AS DOUBLE) / o_all, 6) FOR x IN [a, b, c, d, e]]) AS null_share FROM n""",
    "value_counts": f"""WITH {HOLEY}
        SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM holey GROUP BY 2
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM holey GROUP BY 2
        UNION ALL SELECT 'o_comment', o_comment, count(*) FROM holey GROUP BY 2""",
    "column_summary": f"""WITH {HOLEY}
        SELECT 0 AS position, 'o_orderkey' AS "column", count(o_orderkey) AS non_null, 'bigint' AS type FROM holey
        UNION ALL SELECT 1, 'o_orderstatus', count(o_orderstatus), 'string' FROM holey
        UNION ALL SELECT 2, 'o_totalprice', count(o_totalprice), 'double' FROM holey
        UNION ALL SELECT 3, 'o_comment', count(o_comment), 'string' FROM holey
        UNION ALL SELECT 4, 'o_orderpriority', count(o_orderpriority), 'string' FROM holey""",
    "document_text": """
        SELECT p_partkey AS uid, concat_ws(chr(10), 'Titre : ' || p_name, CASE WHEN p_size > 10 THEN 'Description : ' || p_type END,
            CASE WHEN p_size > 20 THEN 'Mots-clés : ' || p_brand END, 'Public : ' || p_size) AS embedding_text
        FROM part""",
    "document_chunks": f"WITH {CHUNKS} SELECT uid, uid || '_' || chunk_index AS chunk_id, chunk_index, chunk_text FROM chunk",
    "normalise_vectors": """
        WITH cells AS (
            SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) * vec_id AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
        norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM cells GROUP BY vec_id)
        SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(CAST(CASE WHEN n > 0 THEN x / n ELSE x END AS FLOAT) AS DOUBLE), 4) AS x
        FROM cells JOIN norms USING (vec_id)""",
    "topk_chunks": f"""WITH {UNIT}
        SELECT query_id, chunk_id, round(CAST(score AS DOUBLE), 4) AS score,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
        FROM scored QUALIFY rank <= 5""",
    "topk_events": f"""WITH {UNIT}, {TOP_EVENTS}
        SELECT query_id, chunk_id, uid, round(CAST(score AS DOUBLE), 4) AS score, rank FROM top""",
    "embed_topk": f"""WITH {CHUNKS}, {EMBEDDED}, {TOP_EVENTS}
        SELECT query_id, chunk_id, uid, round(CAST(score AS DOUBLE), 4) AS score, rank FROM top""",
    "alignment_check": """
        SELECT (SELECT count(*) FROM labels) AS vectors, (SELECT count(*) FROM documents) AS documents,
            (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS vectors_without_document,
            (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS documents_without_vector,
            (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1 UNION SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys""",
    "index_check": """
        SELECT count(*) AS vectors, CAST(min(len(embedding)) AS INTEGER) AS min_dimension,
            CAST(max(len(embedding)) AS INTEGER) AS max_dimension, count(*) FILTER (embedding IS NULL) AS broken
        FROM embeddings""",
    "question_guards": f"""
        SELECT item_id AS query_id, CASE WHEN item_id = 3 THEN ' ' || chr(10) || ' '
                WHEN item_id BETWEEN 1 AND 10 THEN {strip("text")} ELSE text || ' ' || chr(10) END AS question,
            CAST(item_id AS INTEGER) AS k, CASE WHEN item_id = 3 THEN 'empty question' WHEN item_id NOT BETWEEN 1 AND 10 THEN 'k out of range' END AS reason
        FROM benchmark""",
    "result_context": f"{RESULTS} SELECT query_id, context FROM contexts",
    "generated_answers": f"""{RESULTS}
        SELECT query_id, 'Quoi de neuf {{context}} ' || query_id AS question,
            'Demande : Quoi de neuf {{context}} ' || query_id || chr(10) || chr(10) || 'Événements :' || chr(10) || chr(10) || coalesce(context, '') AS answer,
            coalesce(n_events, 0) AS n_events
        FROM (SELECT DISTINCT label AS query_id FROM embeddings) LEFT JOIN contexts USING (query_id)""",
    "build_stages": f"""WITH {LINES},
        n AS (SELECT CAST(sum(chunks) AS BIGINT) AS chunks FROM parts)
        SELECT 'raw' AS stage, (SELECT count(*) FROM tagged) AS rows, CAST(NULL AS INTEGER) AS dimension
        UNION ALL SELECT 'clean', (SELECT count(DISTINCT uid) FROM tagged), NULL
        UNION ALL SELECT 'chunks', chunks, NULL FROM n
        UNION ALL SELECT 'vectors', chunks, 64 FROM n""",
    "landed_pages": """
        SELECT CAST(conv_id AS VARCHAR) AS agenda_uid, conv_id || '-' || turn AS uid, role AS title, false AS unreadable
        FROM conversations WHERE turn <> 7 AND role IN ('user', 'assistant')
        UNION ALL SELECT CAST(conv_id AS VARCHAR), conv_id || '-' || turn || 'b', 'reply', false
        FROM conversations WHERE turn <> 7 AND role = 'assistant'
        UNION ALL SELECT CAST(conv_id AS VARCHAR), NULL, NULL, true FROM conversations WHERE turn = 7""",
    "rebuild_job": f"""WITH {LINES}
        SELECT CAST(1 AS BIGINT) AS version, (SELECT count(DISTINCT uid) FROM tagged) AS clean_events,
            CAST(sum(chunks) AS BIGINT) AS chunks, 64 AS embedding_dimension, CAST(sum(chunks) AS BIGINT) AS indexed_vectors
        FROM parts""",
    "stored_vectors": f"""WITH {LINES}
        SELECT uid || '_' || i AS chunk_id, uid, title, CAST(1 AS DOUBLE) AS squared_length
        FROM (SELECT uid, title, unnest(generate_series(0, chunks - 1)) AS i FROM parts)""",
    "polymorphic_cells": """
        SELECT CAST(c_custkey AS VARCHAR) AS uid,
            CASE c_custkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN '{}' WHEN 2 THEN NULL ELSE 'd' END AS description,
            CASE c_custkey % 5 WHEN 0 THEN '[Jazz] concert' WHEN 1 THEN 'a, b' WHEN 2 THEN NULL ELSE '{x}' END AS keywords,
            CASE c_custkey % 5 WHEN 0 THEN '[x].jpg' WHEN 1 THEN 'u/f' END AS image
        FROM customer""",
    "topk_own_k": """
        SELECT DISTINCT label AS query_id, CAST(label + 1 AS BIGINT) AS n, CAST(label + 1 AS INTEGER) AS last FROM embeddings""",
    "answered_questions": f"""
        SELECT item_id AS query_id, {strip("text")} AS question, true AS answered
        FROM benchmark WHERE item_id % 5 IN (1, 2, 3) AND item_id <> 3""",
    "answer_events": f"""WITH {CHUNKS}, {EMBEDDED},
        asked AS (
            SELECT item_id AS query_id, CAST(item_id % 12 AS INTEGER) AS k, {strip("text")} AS question FROM benchmark
            WHERE item_id % 12 BETWEEN 1 AND 10 AND item_id <> 3),
        fetched AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored JOIN asked USING (query_id) QUALIFY r <= 3 * k),
        once AS (
            SELECT *, row_number() OVER (PARTITION BY query_id, uid ORDER BY r) AS n FROM fetched QUALIFY n = 1),
        top AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS place FROM once QUALIFY place < k),
        shown AS (
            SELECT t.query_id, t.place, t.uid, t.chunk_id, t.question, c.chunk_text FROM top t JOIN chunk c ON t.chunk_id = c.uid || '_' || c.chunk_index),
        contexts AS (
            SELECT query_id, md5('Demande : ' || any_value(question) || chr(10) || chr(10) || 'Événements :' || chr(10) || chr(10)
                || string_agg('Titre : ' || chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS answer_md5
            FROM shown GROUP BY query_id)
        SELECT query_id, CAST(place AS INTEGER) AS place, uid, chunk_id, md5(chunk_text) AS title_md5, answer_md5 FROM shown JOIN contexts USING (query_id)""",
}
