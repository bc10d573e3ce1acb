"""Given tables and the order-matching inputs derived from them.

Each derived input is one SQL text that Spark and an ANSI engine read alike: `{part}` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


VIEWS = {
    "catalog": """
        SELECT p_brand AS owner_code, concat('SK', lpad(cast(p_partkey AS varchar(12)), 8, '0')) AS sku_code,
          concat('C', cast(p_partkey AS varchar(12))) AS customer_code,
          CASE WHEN p_partkey % 3 = 0 THEN concat(replace(p_name, ' ', '_'), '/', lower(substring(p_type, 1, 4)))
            ELSE replace(p_name, ' ', '_') END AS sku_name,
          CASE p_size % 3 WHEN 0 THEN '箱' WHEN 1 THEN '包' ELSE '件' END AS unit,
          CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'large' ELSE 'small' END AS unit_type,
          cast(CASE p_size % 3 WHEN 0 THEN 12 WHEN 1 THEN 6 ELSE 1 END AS decimal(10,2)) AS conversion_ratio,
          CASE WHEN p_size % 5 = 0 THEN '' ELSE concat(cast(p_size AS varchar(12)), '包*', cast(1 + p_partkey % 4 AS varchar(12)), 'KG') END AS product_spec,
          CASE WHEN p_partkey % 11 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
        FROM {part}""",
    "order_lines": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_suppkey AS supplier_id, owner_code, sku_code AS true_sku,
          true_unit_type,
          CASE (l_orderkey + l_partkey + l_linenumber) % 8 WHEN 0 THEN sku_name WHEN 1 THEN concat(sku_name, '-')
            WHEN 2 THEN concat(sku_name, '(', cast(p_size AS varchar(12)), '包*', cast(1 + p_partkey % 4 AS varchar(12)), 'KG)')
            WHEN 3 THEN concat(' ', sku_name, ' ') WHEN 4 THEN substring(sku_name, 1, length(sku_name) - 2)
            WHEN 5 THEN concat('new ', sku_name) WHEN 6 THEN customer_code
            ELSE CASE WHEN l_suppkey % 2 = 0 THEN concat('nick ', sku_name) ELSE concat('zq', cast(l_suppkey AS varchar(12))) END END AS product_name,
          CASE (p_size + l_linenumber % 2) % 3 WHEN 0 THEN '箱' WHEN 1 THEN '包' ELSE '件' END AS unit,
          cast(floor(l_quantity) AS bigint) AS quantity, l_returnflag AS flag, l_extendedprice AS amount
        FROM {lineitem} JOIN (SELECT p_partkey, p_size, p_brand AS owner_code,
            concat('SK', lpad(cast(p_partkey AS varchar(12)), 8, '0')) AS sku_code,
            concat('C', cast(p_partkey AS varchar(12))) AS customer_code,
            CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_size % 3 = 0 THEN 'large' ELSE 'small' END AS true_unit_type,
            CASE WHEN p_partkey % 3 = 0 THEN concat(replace(p_name, ' ', '_'), '/', lower(substring(p_type, 1, 4)))
              ELSE replace(p_name, ' ', '_') END AS sku_name
          FROM {part}) p ON l_partkey = p_partkey""",
    "table_aliases": """
        SELECT DISTINCT p_brand AS owner_code, concat('nick ', replace(p_name, ' ', '_')) AS order_name,
          replace(p_name, ' ', '_') AS system_name
        FROM {part} WHERE length(p_name) % 2 = 0""",
    "file_aliases": """
        SELECT DISTINCT cast(length(p_name) AS bigint) AS seq, CASE WHEN length(p_name) % 3 = 0 THEN NULL ELSE p_brand END AS owner_code,
          concat('nick ', replace(p_name, ' ', '_')) AS order_name, replace(p_name, ' ', '_') AS system_name
        FROM {part}""",
    "stores": """
        SELECT concat('ST', lpad(cast(c_custkey AS varchar(12)), 8, '0')) AS store_code,
          concat(c_mktsegment, '-', n_name, '-', cast(c_custkey AS varchar(12))) AS store_name,
          concat('Brand#', cast(1 + c_custkey % 25 AS varchar(12))) AS owner_code,
          concat('139', lpad(cast(CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1 ELSE c_custkey END AS varchar(12)), 8, '0')) AS phone,
          n_name AS warehouse, concat(n_name, ' street ', cast(c_custkey % 97 AS varchar(12))) AS address,
          concat('P', cast(c_custkey AS varchar(12))) AS contact_person
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "owners": """
        SELECT concat('Brand#', cast(1 + s_suppkey % 25 AS varchar(12))) AS customer_id,
          concat(s_name, ' of NATION_', cast(s_nationkey AS varchar(12))) AS customer_name,
          CASE WHEN s_suppkey % 9 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
        FROM {supplier}""",
    "warehouses": """
        SELECT n_name AS warehouse_name, CASE WHEN n_nationkey % 8 = 7 THEN '' ELSE concat('W', cast(n_nationkey AS varchar(12))) END AS warehouse_code
        FROM {nation} WHERE n_nationkey % 6 <> 5""",
    "store_requests": """
        SELECT o_orderkey AS request_id, store_code AS true_store,
          CASE o_orderkey % 7 WHEN 0 THEN store_name WHEN 1 THEN substring(store_name, 1, length(store_name) - 1)
            WHEN 2 THEN concat(store_name, '-X') WHEN 3 THEN '店铺1' WHEN 4 THEN substring(store_name, 3)
            WHEN 5 THEN concat('ZZ', store_name) ELSE concat('QQ', cast(o_custkey AS varchar(12))) END AS store_name,
          CASE WHEN o_orderkey % 3 = 0 THEN phone ELSE '' END AS phone,
          CASE WHEN o_orderkey % 5 = 1 THEN address ELSE '' END AS address,
          CASE WHEN o_orderkey % 5 = 2 THEN warehouse ELSE '' END AS contact_person,
          CASE WHEN o_orderkey % 29 = 0 THEN concat('NATION_', cast(o_custkey % 25 AS varchar(12))) ELSE '' END AS company,
          owner_code
        FROM {orders} JOIN (SELECT c_custkey, concat('ST', lpad(cast(c_custkey AS varchar(12)), 8, '0')) AS store_code,
            concat(c_mktsegment, '-', n_name, '-', cast(c_custkey AS varchar(12))) AS store_name,
            concat('139', lpad(cast(CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1 ELSE c_custkey END AS varchar(12)), 8, '0')) AS phone,
            concat(n_name, ' street ', cast(c_custkey % 97 AS varchar(12))) AS address, n_name AS warehouse,
            concat('Brand#', cast(1 + c_custkey % 25 AS varchar(12))) AS owner_code
          FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) s ON o_custkey = c_custkey""",
    "order_metrics": """
        SELECT o_orderpriority AS agent_id, cast(o_orderdate AS date) AS order_date, o_orderkey AS order_id, o_custkey AS customer_id,
          CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'user_rejected' END AS status,
          cast(coalesce(n, 0) AS bigint) AS sku_count, cast(coalesce(m, 0) AS bigint) AS matched_sku_count,
          cast(floor(o_totalprice) AS bigint) AS processing_time_ms,
          concat('v5.', cast(o_orderkey % 3 AS varchar(12))) AS skill_version
        FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS m
          FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""",
    "feedback": """
        SELECT o_orderkey AS feedback_id, cast(o_orderdate AS date) AS order_date, concat('v5.', cast(o_orderkey % 3 AS varchar(12))) AS skill_version,
          concat('Brand#', cast(1 + o_custkey % 25 AS varchar(12))) AS owner_code,
          1 AS store_count, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS matched_store_count,
          cast(coalesce(n, 0) AS bigint) AS sku_count, cast(coalesce(m, 0) AS bigint) AS matched_sku_count,
          CASE WHEN o_orderkey % 4 = 0 THEN 1.0e0 ELSE 0.75e0 END AS store_match_rate,
          CASE WHEN coalesce(n, 0) = 0 THEN 0.0e0 ELSE cast(m AS double) / n END AS sku_match_rate,
          o_orderstatus = 'F' AS user_confirmed, o_orderkey % 5 = 0 AS user_modified,
          cast(floor(o_totalprice / 100) AS bigint) AS processing_time_ms,
          CASE o_orderkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[{{"type":"sku","original_name":"a","corrected":"b","match_layer":"L1","match_score":0.5}}]'
            ELSE '[{{"type":"store","original":"s","corrected":"t"}},{{"type":"sku","original_name":"c","match_score":0.25,"auto_matched":false}}]' END AS corrections,
          CASE WHEN o_orderkey % 6 = 0 THEN '[{{"kind":"unmatched"}}]' ELSE '[]' END AS alerts
        FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS m
          FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""",
    "corrections": """
        SELECT event_id AS correction_id, ts AS created_at, CASE WHEN event_id % 4 = 0 THEN 'store' ELSE 'sku' END AS correction_type,
          concat('item', cast(user_id % 40 AS varchar(12))) AS entity_name, concat('SK', cast(event_id % 3 AS varchar(12))) AS corrected_value,
          concat('layer_', cast(1 + event_id % 5 AS varchar(12))) AS match_layer, floor(value * 100) / 50000.0e0 AS match_score,
          event_id % 2 = 0 AS auto_matched, event_id % 15000 AS feedback_id
        FROM {events} WHERE event_type = 'error'""",
    "alerts": """
        SELECT event_id AS alert_id, ts AS created_at, CASE event_id % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS agent_id,
          event_id % 15000 AS order_id, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity,
          event_id % 5 = 0 AS is_resolved
        FROM {events} WHERE event_type = 'click'""",
    "order_events": """
        SELECT event_id, ts, user_id AS session_id, CASE event_type WHEN 'view' THEN 'store_confirm_needed' WHEN 'click' THEN 'store_confirmed'
            WHEN 'signup' THEN 'sku_corrected' WHEN 'purchase' THEN 'order_complete'
            ELSE CASE WHEN event_id % 2 = 0 THEN 'order_cancelled' ELSE 'user_modified' END END AS event_type, value, props
        FROM {events}""",
    "operation_log": """
        SELECT o_orderdate AS ts, concat('agent', cast(o_orderkey % 2 AS varchar(12))) AS skill_name, cast(o_orderkey AS varchar(20)) AS order_id,
          o_orderstatus <> 'O' AS matched, cast(o_orderkey % 101 AS double) / 100.0e0 AS confidence,
          CASE o_orderkey % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'correct' WHEN 2 THEN 'skip' ELSE 'auto' END AS user_action,
          CASE WHEN o_orderstatus = 'O' THEN concat('error', cast(o_orderkey % 7 AS varchar(12))) ELSE '' END AS error,
          concat('store', cast(o_custkey % 50 AS varchar(12))) AS store_id, o_orderkey % 9 AS item_count,
          cast(floor(o_totalprice) AS bigint) AS processing_time_ms
        FROM {orders}""",
    "order_texts": """
        SELECT o_orderkey AS doc_id, concat('订单编号：', cast(o_orderkey AS varchar(20)), chr(10), '门店名称 店', cast(o_custkey AS varchar(20)), chr(10),
            CASE WHEN o_orderkey % 3 = 0 THEN concat('联系人: 张', cast(o_orderkey % 7 AS varchar(20)), chr(10)) ELSE '' END,
            '电话:139', lpad(cast(o_custkey AS varchar(20)), 8, '0'), chr(10), CASE WHEN o_orderkey % 4 = 0 THEN concat('订单号 again', chr(10)) ELSE '' END,
            '1 P', lpad(cast(o_orderkey AS varchar(20)), 6, '0'), ' 椰果 果粒 规格：2kg*10袋 ', cast(1 + o_orderkey % 9 AS varchar(20)), ' 件', chr(10),
            '2、 红茶 ', cast(o_custkey % 5 AS varchar(20)), ' 箱', chr(10), '3. Black tea 500g x ', cast(2 + o_custkey % 3 AS varchar(20)), chr(10), 'no item 5') AS text
        FROM {orders}""",
    "messages": """
        SELECT conv_id AS session_id, turn, role, CASE (conv_id + turn) % 8 WHEN 0 THEN concat('**思考 plan** ', text)
            WHEN 1 THEN concat(substring(text, 1, 40), ' confirm') WHEN 2 THEN concat('第', cast(turn + 1 AS varchar(20)), '行数量改成', cast(conv_id AS varchar(20)))
            WHEN 3 THEN '所有单位类型都改成large' WHEN 4 THEN '确认生成' WHEN 5 THEN concat('拒绝 ', text) WHEN 6 THEN concat('1. ', text, chr(10), '- second') ELSE text END AS content,
          CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN '[{{"name":"execute","arguments":"go"}},{{"name":"_match_store","arguments":"st"}}]'
            WHEN role = 'assistant' THEN '[{{"name":"order_parser","arguments":"x"}}]' END AS tool_calls
        FROM {conversations}""",
    "snippets": """
        SELECT doc_id, source, lang, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(text, ' 联系人：李', cast(doc_id AS varchar(20)), '号 13', lpad(cast(doc_id AS varchar(20)), 9, '5'))
            WHEN 2 THEN concat('mail Shop', cast(doc_id % 50 AS varchar(20)), '@example.com or x@qq.com 经理 Wang, 010)12345678 ', text) ELSE concat('a@qq.com ', text) END AS text
        FROM {documents}""",
    "records": """
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('2026-01-02 完成 ', text, ' 因为 a1b2c3d4') WHEN 1 THEN concat('修复 bug 原因 87% ', text) WHEN 2 THEN concat('2025-03-04 ', text)
            WHEN 3 THEN concat('# Title ', cast(doc_id AS varchar(20)), chr(10), '- [x] done one', chr(10), '✅ done two', chr(10), '**决定** use it', chr(10), text, chr(10), 'Bug fixed 修复') ELSE text END AS text,
          doc_id % 60 AS age_days
        FROM {documents}""",
    "traces": """
        SELECT concat('agent', cast(user_id % 3 AS varchar(12))) AS agent_id, user_id AS session_id, event_id AS step_no, ts AS created_at,
          CASE event_type WHEN 'view' THEN 'reasoning' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'tool_call' ELSE 'user_action' END AS step_type,
          CASE WHEN event_type IN ('click', 'purchase') THEN concat('tool', cast(event_id % 13 AS varchar(12))) END AS tool_name,
          CASE WHEN event_type = 'signup' THEN 'confirm' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'reject'
            WHEN event_type = 'error' THEN 'modify' END AS action
        FROM {events}""",
}


# Order sheets: ten part rows each; the header of a sheet follows from its number, every fourth sheet has no known layout.
_BODY = ["cast(p_partkey AS varchar(20))", "CASE WHEN p_partkey % 4 = 0 THEN concat('店', cast(p_partkey AS varchar(20))) END", "p_name",
         "cast(p_size AS varchar(20))", "'箱'", "concat(cast(p_size AS varchar(20)), 'KG')"]
_HEADS = [["序号", "门店名称", "商品名称", "数量", "单位", "规格"], ["序号", "门店名称", "产品名称", "地址", "电话", "规格"],
          ["序号", "客户名称*", "商品名称*", "出库数量*", "单位", "电话"], ["a", "b", "c", "d", "e", "f"]]


def _sheet_cells() -> str:
    parts = [f"SELECT p_partkey - p_partkey % 10 AS doc_id, 2 + p_partkey % 10 AS row, cast({i} AS bigint) AS col, {v} AS value FROM {{part}}"
             for i, v in enumerate(_BODY)]
    for i in range(6):
        label = " ".join(f"WHEN {k} THEN '{h[i]}'" for k, h in enumerate(_HEADS))
        parts.append(f"SELECT p_partkey AS doc_id, cast(1 AS bigint) AS row, cast({i} AS bigint) AS col, "
                     f"CASE cast(floor(p_partkey / 10) AS bigint) % 4 {label} END AS value FROM {{part}} WHERE p_partkey % 10 = 0")
    return " UNION ALL ".join(parts)


VIEWS["sheet_cells"] = _sheet_cells()


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, folder, t) for t in tables_of(sql)})


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """An ANSI query text whose derived inputs stand in a WITH clause."""
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in tables_of(VIEWS[n])})})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts + [body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts + [body[5:]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
