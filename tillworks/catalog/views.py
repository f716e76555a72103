"""DuckDB text of the shop tables, inlined as CTEs into the check queries."""

from __future__ import annotations

import re

SECOND_OF_DAY = "(o_orderkey * 7919 % 86400)"

VIEWS: dict[str, str] = {
    "pos_admins": """
SELECT CAST(s_suppkey AS BIGINT) AS id, 'staff' || CAST(s_suppkey AS VARCHAR) AS username,
 CASE WHEN s_suppkey % 10 = 0 THEN 'super' ELSE 'admin' END AS role, s_suppkey % 9 <> 0 AS is_active,
 CASE WHEN s_suppkey % 3 = 1 THEN '09:00' WHEN s_suppkey % 3 = 2 THEN '17:00' END AS login_from,
 CASE WHEN s_suppkey % 3 = 1 THEN '22:00' WHEN s_suppkey % 3 = 2 THEN '02:00' END AS login_to,
 s_suppkey % 2 = 0 AS auto_approve FROM supplier""",
    "pos_menu_items": """
SELECT p_partkey AS id, p_name AS name, p_type AS category,
 CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_partkey % 11 <> 0 AS is_active FROM part""",
    "pos_customers": """
SELECT CAST(9000000000 + c_custkey AS VARCHAR) AS phone, c_name AS name FROM customer WHERE c_custkey % 10 <> 0""",
    "pos_orders": f"""
SELECT o_orderkey AS id,
 CASE WHEN o_custkey % 10 <> 0 THEN CAST(9000000000 + o_custkey AS VARCHAR) END AS phone,
 CASE WHEN o_custkey % 10 <> 0 THEN 'Customer ' || CAST(o_custkey AS VARCHAR) END AS customer_name,
 CAST(o_totalprice AS DECIMAL(10,2)) AS total,
 CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS payment_status,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'cash' WHEN '5-LOW' THEN 'cash' WHEN '2-HIGH' THEN 'upi' WHEN '3-MEDIUM' THEN 'card' END AS payment_method,
 CASE o_orderkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'preparing' WHEN 2 THEN 'ready' ELSE 'served' END AS kitchen_status,
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL '1' SECOND * ({SECOND_OF_DAY} + 600) END AS kitchen_updated_at,
 CASE WHEN o_custkey % 20 <> 0 THEN o_custkey % 20 END AS created_by,
 CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 12 + 1 END AS coupon_id,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(5 AS DECIMAL(10,2)) ELSE CAST(0 AS DECIMAL(10,2)) END AS discount,
 o_orderdate + INTERVAL '1' SECOND * {SECOND_OF_DAY} AS created_at FROM orders""",
    "pos_order_items": """
SELECT l_orderkey AS order_id,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS line_no,
 l_partkey AS menu_item_id, p_name AS item_name, CAST(p_retailprice AS DECIMAL(10,2)) AS price, CAST(l_quantity AS INT) AS qty
 FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "pos_ingredients": """
SELECT s_suppkey AS id, s_name AS name,
 CASE s_suppkey % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' WHEN 3 THEN 'l' ELSE 'pcs' END AS unit,
 s_suppkey % 4 <> 0 AS track_stock, CAST(s_acctbal AS DECIMAL(14,3)) AS stock,
 CASE WHEN s_suppkey % 3 = 0 THEN CAST(2000 AS DECIMAL(14,3)) END AS low_stock_at FROM supplier""",
    "pos_menu_item_ingredients": """
SELECT p_partkey AS menu_item_id, (p_partkey * 7 + k * 13) % (SELECT count(*) FROM supplier) AS ingredient_id,
 CAST(CAST(p_size AS DECIMAL(12,3)) * (k + 1) AS DECIMAL(12,3)) AS qty
 FROM part CROSS JOIN (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE p_partkey % 6 <> 0 AND k <= p_size % 3""",
    "pos_login_attempts": """
SELECT event_id AS id, 'staff' || CAST(user_id % 25 AS VARCHAR) AS username,
 '10.0.0.' || CAST(event_id % 40 AS VARCHAR) AS ip, event_type <> 'error' AS succeeded, ts AS created_at
 FROM events WHERE event_type IN ('error','signup')""",
    "pos_login_bursts": """
SELECT id, username, '10.0.0.' || CAST(id % 8 AS VARCHAR) AS ip, succeeded,
 TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(created_at) - epoch_us(TIMESTAMP '2024-01-01')) // 240) AS created_at
 FROM pos_login_attempts""",
    "pos_sessions": """
SELECT event_id AS id, user_id % 25 AS admin_id, '10.0.0.' || CAST(event_id % 40 AS VARCHAR) AS ip,
 CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL '60' SECOND END AS approved_at,
 CASE WHEN event_id % 3 <> 0 THEN (event_id % 2) * 10 END AS approved_by,
 ts AS created_at, ts + INTERVAL '12' HOUR AS expires_at FROM events WHERE event_type = 'signup'""",
    "pos_session_events": """
SELECT id AS session_id, admin_id, 'login' AS event, created_at AS ts FROM pos_sessions
UNION ALL SELECT id, admin_id, CASE WHEN id % 4 = 2 THEN 'deny' ELSE 'approve' END, created_at + INTERVAL '5' MINUTE FROM pos_sessions WHERE id % 4 <> 0
UNION ALL SELECT id, admin_id, CASE WHEN id % 8 = 3 THEN 'logout' ELSE 'revoke' END, created_at + INTERVAL '3' HOUR FROM pos_sessions WHERE id % 4 = 3""",
    "pos_audit_log": """
SELECT event_id AS id, 'staff' || CAST(user_id % 20 AS VARCHAR) AS admin_username,
 CASE event_type WHEN 'click' THEN 'order.status' WHEN 'view' THEN 'kitchen.status' WHEN 'purchase' THEN 'stock.purchase' WHEN 'signup' THEN 'staff.create' ELSE 'menu.update' END AS action,
 CAST(user_id AS VARCHAR) AS entity_id, props AS details, ts AS created_at FROM events""",
    "pos_stock_events": """
SELECT event_id AS id, user_id % 100 AS ingredient_id,
 CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'view' THEN 'waste' WHEN 'signup' THEN 'count' WHEN 'click' THEN 'sale' ELSE 'sale_reversal' END AS kind,
 CAST(value AS DECIMAL(14,3)) AS qty, CASE WHEN event_type IN ('click','error') THEN event_id % 500 END AS order_id, ts AS created_at FROM events""",
    "pos_status_events": """
SELECT event_id AS id, user_id AS order_id,
 CASE WHEN event_type IN ('purchase','click') THEN 'paid' WHEN event_type IN ('view','signup') THEN 'pending' ELSE 'cancelled' END AS payment_status,
 CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'preparing' WHEN 2 THEN 'ready' ELSE 'served' END AS kitchen_status,
 ts AS created_at FROM events""",
    "pos_shifts": """
SELECT admin_id * 1000000 + year(m) * 100 + month(m) AS id, admin_id, opened_at,
 CASE WHEN admin_id % 7 <> 0 THEN opened_at + INTERVAL '12' HOUR END AS closed_at, CAST(500 AS DECIMAL(10,2)) AS opening_cash,
 CASE WHEN admin_id % 7 <> 0 THEN CASE WHEN month(m) % 4 = 0 THEN 0 ELSE admin_id END END AS closed_by,
 CASE WHEN admin_id % 7 <> 0 THEN CAST(500 + month(m) * 1000 AS DECIMAL(10,2)) END AS counted_cash
 FROM (SELECT created_by AS admin_id, date_trunc('month', created_at) AS m, min(created_at) AS opened_at FROM pos_orders WHERE created_by IS NOT NULL GROUP BY 1, 2)""",
    "pos_coupons": """
SELECT CAST(id AS BIGINT) AS id, code, kind, CAST(value AS DECIMAL(10,2)) AS value, CAST(max_discount AS DECIMAL(10,2)) AS max_discount, CAST(min_bill AS DECIMAL(10,2)) AS min_bill,
 CAST(buy_qty AS INTEGER) AS buy_qty, CAST(get_qty AS INTEGER) AS get_qty, applies_to, item_ids, categories, CAST(valid_from AS DATE) AS valid_from, CAST(valid_to AS DATE) AS valid_to, CAST(usage_limit AS INTEGER) AS usage_limit, CAST(per_customer_limit AS INTEGER) AS per_customer_limit, is_active,
 TIMESTAMP '1994-01-01' + INTERVAL '1' DAY * id AS created_at FROM (VALUES
 (1,'PCT10','percent',10.00,NULL,0.00,NULL,NULL,'all',CAST([] AS BIGINT[]),CAST([] AS VARCHAR[]),NULL,NULL,5,NULL,true),
 (2,'PCT50','percent',50.00,500.00,1000.00,NULL,NULL,'all',[],[],NULL,NULL,NULL,1,true),
 (3,'FLAT100','flat',100.00,NULL,0.00,NULL,NULL,'all',[],[],NULL,NULL,20,NULL,true),
 (4,'FLATSM','flat',250.00,NULL,500.00,NULL,NULL,'items',[],['SMALL'],NULL,NULL,NULL,NULL,true),
 (5,'B1G1','bogo',0.00,NULL,0.00,1,1,'all',[],[],NULL,NULL,NULL,NULL,true),
 (6,'B2G1','bogo',0.00,5000.00,0.00,2,1,'items',[],['PROMO'],NULL,NULL,NULL,2,true),
 (7,'OFF','percent',10.00,NULL,0.00,NULL,NULL,'all',[],[],NULL,NULL,NULL,NULL,false),
 (8,'LATER','flat',50.00,NULL,0.00,NULL,NULL,'all',[],[],'2001-01-01',NULL,NULL,NULL,true),
 (9,'GONE','percent',12.50,300.00,0.00,NULL,NULL,'all',[],[],NULL,'1997-12-31',NULL,NULL,true),
 (10,'PICKED','percent',20.00,NULL,50000.00,NULL,NULL,'items',[1,2,3,999999999],['ECONOMY'],'1996-01-01','2000-12-31',400,2,true)
 UNION ALL SELECT 1000 + s_suppkey, 'SUP-' || CAST(s_suppkey AS VARCHAR), CASE s_suppkey % 3 WHEN 0 THEN 'percent' WHEN 1 THEN 'flat' ELSE 'bogo' END,
 CASE s_suppkey % 3 WHEN 0 THEN 5 + s_suppkey % 20 WHEN 1 THEN 50 + s_suppkey % 100 ELSE 0 END, CASE WHEN s_suppkey % 4 = 0 THEN 200 END, s_suppkey % 5 * 100,
 CASE WHEN s_suppkey % 3 = 2 THEN 2 END, CASE WHEN s_suppkey % 3 = 2 THEN 1 END, CASE WHEN s_suppkey % 7 = 0 THEN 'items' ELSE 'all' END,
 CASE WHEN s_suppkey % 7 = 0 THEN [CAST(s_suppkey + 1 AS BIGINT), CAST(s_suppkey + 2 AS BIGINT)] ELSE CAST([] AS BIGINT[]) END, CAST([] AS VARCHAR[]), NULL, CASE WHEN s_suppkey % 6 = 0 THEN '1997-12-31' END,
 CASE WHEN s_suppkey % 4 = 1 THEN 10 + s_suppkey % 50 END, CASE WHEN s_suppkey % 5 = 2 THEN 1 END, s_suppkey % 9 <> 0 FROM supplier
) AS t(id, code, kind, value, max_discount, min_bill, buy_qty, get_qty, applies_to, item_ids, categories, valid_from, valid_to, usage_limit, per_customer_limit, is_active)""",
    "pos_coupon_bills": """
SELECT id, phone, created_at, payment_status,
 CASE id % 12 WHEN 1 THEN ' pct10 ' WHEN 2 THEN ' pct50 ' WHEN 3 THEN ' flat100 ' WHEN 4 THEN ' flatsm ' WHEN 5 THEN ' b1g1 ' WHEN 6 THEN ' b2g1 '
 WHEN 7 THEN ' off ' WHEN 8 THEN ' later ' WHEN 9 THEN ' gone ' WHEN 10 THEN ' picked ' WHEN 11 THEN 'NOPE' ELSE ' ' END AS code FROM pos_orders""",
    "pos_bills": f"""
SELECT o_orderkey AS id,
 CASE WHEN o_custkey % 10 = 0 THEN ' ' WHEN o_orderkey % 37 = 0 THEN '98-76'
  ELSE '(' || CAST(90000 + o_custkey % 1000 AS VARCHAR) || ') ' || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') END AS phone,
 CASE WHEN o_orderkey % 2 = 0 THEN ' Guest ' || CAST(o_custkey AS VARCHAR) || ' ' WHEN o_orderkey % 5 = 0 THEN '  ' END AS customer_name,
 CASE WHEN o_orderkey % 7 = 0 THEN ' UPI ' WHEN o_orderkey % 7 = 1 THEN 'Card' WHEN o_orderkey % 53 = 0 THEN 'cheque' WHEN o_orderkey % 7 = 2 THEN 'CASH' END AS payment_method,
 CASE o_orderkey % 24 WHEN 1 THEN ' pct10 ' WHEN 2 THEN ' pct50 ' WHEN 3 THEN ' flat100 ' WHEN 4 THEN ' flatsm ' WHEN 5 THEN ' b1g1 ' WHEN 6 THEN ' b2g1 '
 WHEN 7 THEN ' off ' WHEN 8 THEN ' later ' WHEN 9 THEN ' gone ' WHEN 10 THEN ' picked ' WHEN 11 THEN 'NOPE' END AS coupon_code,
 CASE WHEN o_orderkey % 41 = 0 THEN '[]' WHEN o_orderkey % 43 = 0 THEN '{{"menu_item_id":1,"qty":1}}' WHEN o_orderkey % 47 = 0 THEN NULL
  ELSE '[' || '{{"menu_item_id":' || CAST(o_custkey + o_orderkey % 5 AS VARCHAR) || ',"qty":' || CAST(o_orderkey % 4 AS VARCHAR) || '}}'
  || CASE WHEN o_orderkey % 3 > 0 THEN ',{{"menu_item_id":' || CAST(o_custkey + o_orderkey % 5 + 17 AS VARCHAR) || ',"qty":' || CAST((o_orderkey + 1) % 4 AS VARCHAR) || '}}' ELSE '' END
  || CASE WHEN o_orderkey % 3 = 2 THEN ',{{"menu_item_id":' || CAST(o_custkey + o_orderkey % 5 + 34 AS VARCHAR) || ',"qty":' || CAST((o_orderkey + 2) % 4 AS VARCHAR) || '}}'
   || ',{{"menu_item_id":' || CAST(o_custkey + o_orderkey % 5 AS VARCHAR) || ',"qty":' || CAST(o_orderkey % 4 AS VARCHAR) || '}}' ELSE '' END || ']' END AS items,
 CASE WHEN o_custkey % 20 <> 0 THEN o_custkey % 20 END AS created_by,
 o_orderdate + INTERVAL '1' SECOND * {SECOND_OF_DAY} AS created_at FROM orders""",
    "pos_bill_lines": """
SELECT id AS bill_id, j AS line_no, CAST(json_extract_string(items, '$[' || CAST(j AS VARCHAR) || '].menu_item_id') AS BIGINT) AS menu_item_id,
 CAST(json_extract_string(items, '$[' || CAST(j AS VARCHAR) || '].qty') AS INTEGER) AS qty
 FROM (SELECT id, items, unnest(range(0, CAST(json_array_length(items) AS BIGINT))) AS j FROM pos_bills WHERE json_type(items) = 'ARRAY')""",
    "pos_settings": """
SELECT c_custkey AS id, 'Shop ' || CAST(c_custkey AS VARCHAR) AS shop_name, CAST(NULL AS VARCHAR) AS shop_address, '080-1' AS shop_phone, '₹' AS currency, CAST(NULL AS VARCHAR) AS upi_id, '91' AS country_code,
 'Thank you! Visit again.' AS receipt_footer, true AS hide_out_of_stock, 'Fresh' AS tagline, CAST(NULL AS VARCHAR) AS whatsapp, 'https://maps/1' AS maps_url, CAST(NULL AS VARCHAR) AS cover_image_url FROM customer""",
    "pos_shop_hours": """
SELECT c_custkey AS shop_id, '{' || concat_ws(',',
 '"mon":{"closed":false,"open":"' || CASE WHEN c_custkey % 17 = 0 THEN '7:00' ELSE lpad(CAST(6 + c_custkey % 4 AS VARCHAR), 2, '0') || ':30' END || '","close":"' || lpad(CAST(21 + c_custkey % 2 AS VARCHAR), 2, '0') || ':30"}',
 '"tue":{"closed":true}',
 CASE WHEN c_custkey % 2 = 0 THEN '"wed":{"closed":false,"open":"' || lpad(CAST(9 + c_custkey % 3 AS VARCHAR), 2, '0') || ':30","close":"' || CASE WHEN c_custkey % 19 = 0 THEN lpad(CAST(9 + c_custkey % 3 AS VARCHAR), 2, '0') ELSE lpad(CAST(20 + c_custkey % 4 AS VARCHAR), 2, '0') END || ':30"}' END,
 CASE WHEN c_custkey % 3 = 0 THEN '"fri":{"closed":false,"open":"' || lpad(CAST(17 + c_custkey % 2 AS VARCHAR), 2, '0') || ':30","close":"02:00"}' END,
 '"sat":{"closed":false,"open":"18:00","close":"03:15"}') || '}' AS opening_hours FROM customer""",
}

_NAME = re.compile(r"\bpos_[a-z_]+\b")


def _needed(text: str, seen: list[str]) -> None:
    for name in _NAME.findall(text):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen.append(name)


def with_views(sql: str, **ctes: str) -> str:
    """Prefixes the shop-table CTEs a query names, then ``ctes`` in order."""
    names: list[str] = []
    _needed(" ".join([*ctes.values(), sql]), names)
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names] + [f"{n} AS ({t.strip()})" for n, t in ctes.items()]
    # A step-by-step text reads itself, and each step its rows: those are computed once.
    steps = [n for n, t in ctes.items() if "UNION ALL SELECT" in t and re.search(rf"\bFROM {n} JOIN t\b", t)]
    if steps:
        parts = [p.replace("t AS (", "t AS MATERIALIZED (", 1) if p.startswith("t AS (") else p for p in parts]
    return (f"WITH {'RECURSIVE ' if steps else ''}{', '.join(parts)} " if parts else "") + sql.strip()
