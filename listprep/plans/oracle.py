"""SQL statements that give the same rows as the registered queries.

They read the test tables alone, share no code with the operators beyond the derived record
view, and use window functions where the operators use aggregates.
"""

from __future__ import annotations

from .derived import VEHICLE_SALES

SALES = "sales AS (" + VEHICLE_SALES.format(orders="orders", customer="customer", nation="nation") + ")"

CODES = """
year_codes(code, yr) AS (VALUES
 ('1',2001),('2',2002),('3',2003),('4',2004),('5',2005),('6',2006),('7',2007),('8',2008),('9',2009),('A',2010),
 ('B',2011),('C',2012),('D',2013),('E',2014),('F',2015),('G',2016),('H',2017),('J',2018),('K',2019),('L',2020),
 ('M',2021),('N',2022),('P',2023),('R',2024),('S',2025),('T',2026),('V',2027),('W',2028),('X',2029),('Y',2030)),
state_zips(st, z2) AS (VALUES
 ('TX','75'),('TX','76'),('TX','77'),('TX','78'),('TX','79'),('CA','90'),('CA','91'),('CA','92'),('CA','93'),
 ('CA','94'),('CA','95'),('CA','96'),('MA','01'),('MA','02'),('OH','43'),('OH','44'),('OH','45'))"""

CLEAN = """
base AS (
 SELECT row_id, first_name, last_name, city, model, bodycode, address_line1,
  veh_acq_type_cd, purchase_date, zip_code AS raw_zip, vin AS raw_vin, state AS raw_state, email_addr,
  lower(trim(email_addr)) AS email,
  upper(trim(coalesce(address_line1, ''))) AS naddrs1, upper(trim(coalesce(city, ''))) AS ncity,
  upper(trim(coalesce(state, ''))) AS nstate, upper(trim(state)) AS state,
  CASE WHEN regexp_full_match(trim(zip_code), '[0-9]+') THEN lpad(trim(zip_code), 5, '0')
       WHEN regexp_full_match(trim(zip_code), '[0-9]{5}-[0-9]{4}') THEN substr(trim(zip_code), 1, 5) END AS zip_code,
  trim(regexp_replace(concat_ws(' ', first_name, last_name), '\\s+', ' ', 'g')) AS name,
  regexp_replace(upper(regexp_replace(vin, '\\.0$', '')), '[^A-Z0-9]', '', 'g') AS vin
 FROM sales),
clean AS (
 SELECT b.*, substr(vin, 1, 3) AS vin13, substr(vin, 4, 5) AS vin48, substr(vin, 10, 1) AS vin10, yr AS modyy,
  substr(zip_code, 1, 2) AS zip2
 FROM base b LEFT JOIN year_codes ON substr(vin, 10, 1) = code),
checked AS (
 SELECT *,
  CASE WHEN coalesce(email, '') = '' THEN NULL
       WHEN regexp_matches(email, '@(?:test.invalid)') OR regexp_matches(email, '\\b(?:noreply)\\b')
         OR NOT regexp_full_match(email, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') THEN 'Invalid email' END AS email_reason,
  CASE WHEN coalesce(lower(trim(veh_acq_type_cd)), '') NOT IN ('lease', 'retail', 'purchase')
       THEN 'Invalid or missing sales type' END AS sales_reason,
  CASE WHEN coalesce(state, '?') NOT IN (SELECT st FROM state_zips) THEN 'Invalid state code'
       WHEN NOT EXISTS (SELECT 1 FROM state_zips WHERE st = clean.state AND z2 = clean.zip2) THEN 'State/ZIP mismatch' END AS geo_reason,
  regexp_matches(name, '(?i)LLC|LEASING|CLUB') AS has_term,
  regexp_matches(lower(coalesce(first_name, '')) || ' ' || lower(coalesce(last_name, '')), '\\bford\\b') AS has_manufacturer,
  lower(name) = 'arie ford club' OR (lower(name) = 'first25 auto leasing llc' AND lower(trim(city)) = 'nation_22') AS is_allowed,
  coalesce(length(vin), 0) = 17 AS vin_ok,
  coalesce(modyy IN (2023, 2024, 2025, 2026), false) AS year_ok
 FROM clean)"""

REFERENCES = """
keys AS (
 SELECT DISTINCT vin13, vin48, vin10 FROM clean WHERE length(vin) = 17),
hashed AS (
 SELECT *, md5(vin13 || vin48 || vin10) AS d FROM keys),
rule_keys AS (
 SELECT *, (strpos('0123456789abcdef', substr(d, 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(d, 2, 1)) - 1 AS h,
  upper(substr(d, 3, 4)) AS code FROM hashed),
rules AS (
 SELECT 2 AS ord, vin13, vin48, vin10, '' AS modelid, 'c' || code AS cell, substr(vin13, 1, 2) AS brand,
  'c model ' || vin48 AS descr FROM rule_keys WHERE h % 5 <> 0
 UNION ALL SELECT 3, vin13, vin48, vin10, '', 'D' || code, substr(vin13, 1, 2), 'D model ' || vin48
  FROM rule_keys WHERE h % 5 <> 0 AND h % 7 = 0
 UNION ALL SELECT 1, vin13, vin48, vin10, 'x1 ', 'X' || code, substr(vin13, 1, 2), 'X model ' || vin48
  FROM rule_keys WHERE h % 5 <> 0 AND h % 3 = 0),
ucc_pairs AS (
 SELECT cell, y, md5(cell || y) AS d FROM (SELECT DISTINCT cell FROM rules UNION SELECT 'DEFAULT'),
  (VALUES ('2023'), ('2024'), ('2025'), ('2026')) AS v(y)),
ucc_hashed AS (
 SELECT *, (strpos('0123456789abcdef', substr(d, 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(d, 2, 1)) - 1 AS h
 FROM ucc_pairs),
ucc_master AS (
 SELECT line AS ord, upper(cell) AS cell, CAST(y AS INTEGER) AS modyy,
  CASE WHEN h % 10 = 1 THEN '' WHEN line = 2 THEN reverse(substr(translate(d, 'abcdef', '012345'), 1, 21))
       ELSE substr(translate(d, 'abcdef', '012345'), 1, 21) END AS ucc,
  'UCC ' || cell AS description
 FROM ucc_hashed, (VALUES (1), (2)) AS l(line) WHERE h % 6 <> 0 AND (line = 1 OR h % 8 = 1)),
desc_hashed AS (
 SELECT cell, (strpos('0123456789abcdef', substr(md5(cell), 1, 1)) - 1) * 16
  + strpos('0123456789abcdef', substr(md5(cell), 2, 1)) - 1 AS h FROM (SELECT DISTINCT cell FROM rules)),
desc_master AS (
 SELECT upper(cell) AS cell, 'Long text ' || cell || '.0 line 1' AS description_long FROM desc_hashed WHERE h % 4 <> 0),
exclusions AS (
 SELECT DISTINCT vin FROM clean WHERE (row_id % 11 = 0 OR row_id % 13 = 0) AND vin IS NOT NULL),
own_rules AS (
 SELECT *, upper(trim(modelid)) AS m FROM rules
 QUALIFY row_number() OVER (PARTITION BY vin13, vin48, vin10, upper(trim(modelid)) ORDER BY ord) = 1),
coded AS (
 SELECT c.*, coalesce(o.cell, s.cell, 'DEFAULT') AS cell, coalesce(o.brand, s.brand, '') AS brand,
  coalesce(o.descr, s.descr, '') AS descr,
  CASE WHEN o.cell IS NOT NULL THEN o.modelid WHEN s.cell IS NOT NULL THEN s.modelid ELSE '' END AS modelid
 FROM checked c
 LEFT JOIN own_rules o ON o.vin13 = c.vin13 AND o.vin48 = c.vin48 AND o.vin10 = c.vin10
  AND o.m = upper(trim(coalesce(c.bodycode, '')))
 LEFT JOIN own_rules s ON s.vin13 = c.vin13 AND s.vin48 = c.vin48 AND s.vin10 = c.vin10 AND s.m = ''
 WHERE vin_ok AND year_ok),
with_ucc AS (
 SELECT c.* REPLACE (upper(c.cell) AS cell), coalesce(nullif(u.ucc, ''), 'MISSING_UCC') AS ucc
 FROM coded c LEFT JOIN (SELECT * FROM ucc_master WHERE ord = 1) u ON u.cell = upper(c.cell) AND u.modyy = c.modyy),
with_desc AS (
 SELECT c.*, coalesce(d.description_long, 'MISSING DESCRIPTION') AS description_long
 FROM with_ucc c LEFT JOIN desc_master d ON d.cell = c.cell)"""

DATES = """
dated AS (
 SELECT row_id, coalesce(
   CASE WHEN regexp_matches(trim(purchase_date), '^[0-9]{4}-[0-9]{2}-[0-9]{2}-')
        THEN try_strptime(substr(trim(purchase_date), 1, 19), '%Y-%m-%d-%H.%M.%S') END,
   try_strptime(trim(purchase_date), '%m/%d/%Y'), try_strptime(trim(purchase_date), '%Y%m%d'),
   try_strptime(trim(purchase_date), '%Y-%m-%d')) AS stamp
 FROM sales)"""

JOB = """
early AS (
 SELECT *, CASE WHEN name = '' THEN 'blank_name' WHEN email_reason IS NOT NULL THEN 'email' END AS step1 FROM checked),
addressed AS (
 SELECT *, CASE WHEN step1 IS NULL THEN row_number() OVER (PARTITION BY step1, naddrs1, ncity, nstate ORDER BY row_id) END AS address_row
 FROM early),
late AS (
 SELECT *, CASE WHEN step1 IS NOT NULL THEN step1 WHEN address_row > 1 THEN 'address_dedup'
  WHEN sales_reason IS NOT NULL THEN 'sales_type' WHEN geo_reason IS NOT NULL THEN 'geography'
  WHEN (has_term OR has_manufacturer) AND NOT is_allowed THEN 'business'
  WHEN NOT vin_ok THEN 'vin' WHEN NOT year_ok THEN 'model_year' END AS step2 FROM addressed),
deduped AS (
 SELECT *, CASE WHEN step2 IS NULL THEN row_number() OVER (PARTITION BY step2, vin ORDER BY naddrs1, ncity, nstate, row_id) END AS vin_row
 FROM late),
tagged AS (
 SELECT *,
  CASE WHEN step2 IS NOT NULL THEN step2 WHEN vin_row > 1 OR vin IN (SELECT vin FROM exclusions) THEN 'dedup' END AS reject_step,
  CASE WHEN step2 = 'blank_name' THEN 'Blank name' WHEN step2 = 'email' THEN email_reason
   WHEN step2 = 'address_dedup' THEN 'Filter_Duplicate_Address' WHEN step2 = 'sales_type' THEN sales_reason
   WHEN step2 = 'geography' THEN geo_reason WHEN step2 = 'business' THEN 'Business' WHEN step2 = 'vin' THEN 'Invalid VIN'
   WHEN step2 = 'model_year' THEN 'Invalid model year' WHEN vin_row > 1 THEN 'Duplicate VIN in file'
   WHEN vin IN (SELECT vin FROM exclusions) THEN 'Duplicate record' END AS reject_reason
 FROM deduped),
kept AS (
 SELECT w.*, CASE WHEN coalesce(w.email, '') = '' THEN 'mail' ELSE 'email' END AS channel
 FROM with_desc w JOIN tagged t USING (row_id) WHERE t.reject_step IS NULL),
numbered AS (
 SELECT k.*, 10000000 + row_number() OVER (ORDER BY naddrs1, ncity, nstate, row_id) AS seq8,
  CASE WHEN channel = 'mail' THEN NULL
   WHEN split_part(email, '@', -1) IN ('gmail.com', 'googlemail.com') THEN 'gmail'
   WHEN split_part(email, '@', -1) IN ('yahoo.com', 'aol.com', 'ymail.com', 'rocketmail.com') THEN 'yahoo_aol' ELSE 'other' END AS panel,
  CASE WHEN lower(trim(veh_acq_type_cd)) = 'lease' THEN 2 ELSE 1 END AS purch_lse,
  CASE WHEN contains(lower(model), 'ev') OR contains(lower(model), 'electric') OR contains(lower(model), 'hybrid') THEN '1' ELSE '0' END AS electric,
  CASE vin13 WHEN 'SAL' THEN 'Land Rover' WHEN 'SAJ' THEN 'Jaguar' ELSE '' END AS true_brand,
  strftime(d.stamp, '%m') AS mo, strftime(d.stamp, '%Y') AS yr
 FROM kept k JOIN dated d USING (row_id)),
final AS (
 SELECT *, row_number() OVER (PARTITION BY panel ORDER BY seq8) AS panel_row,
  CASE WHEN contains(email, '@') THEN split_part(email, '@', -1) ELSE 'unknown' END AS domain FROM numbered)"""

PANELS = """
panelled AS (
 SELECT *, CASE WHEN domain IN ('gmail.com', 'googlemail.com') THEN 'gmail'
  WHEN domain IN ('yahoo.com', 'aol.com', 'ymail.com', 'rocketmail.com') THEN 'yahoo_aol' ELSE 'other' END AS panel
 FROM (SELECT *, split_part(email, '@', -1) AS domain FROM base WHERE email <> '')),
chunked AS (
 SELECT row_id, panel, row_number() OVER w AS panel_row, CAST(ceil(count(*) OVER (PARTITION BY panel) / 4500.0) AS BIGINT) AS n_chunks
 FROM panelled WINDOW w AS (PARTITION BY panel ORDER BY naddrs1, ncity, nstate, row_id))"""

DECODERS = """
valid AS (SELECT row_id, vin, model FROM base WHERE length(vin) = 17),
decode_all AS (
 SELECT row_id, vin, CASE WHEN row_id % 4 = 1 THEN NULL ELSE substr(vin, 1, 3) END AS make, substr(vin, 10, 1) AS model_year,
  src, CASE WHEN row_id % 19 = 0 THEN model || suffix ELSE model END AS model
 FROM valid, (VALUES ('a', ''), ('b', ' B'), ('c', ' C')) AS s(src, suffix)
 WHERE (src = 'a' AND row_id % 2 = 0) OR (src = 'b' AND row_id % 3 = 0) OR (src = 'c' AND row_id % 5 <= 1)),
decode_first AS (
 SELECT * FROM decode_all QUALIFY row_number() OVER (PARTITION BY src, vin ORDER BY row_id) = 1),
decode_wide AS (
 SELECT v.vin, a.make AS make_a, b.make AS make_b, c.make AS make_c, a.model AS model_a, b.model AS model_b, c.model AS model_c,
  a.model_year AS year_a, b.model_year AS year_b, c.model_year AS year_c
 FROM (SELECT DISTINCT vin FROM decode_first) v
 LEFT JOIN (SELECT * FROM decode_first WHERE src = 'a') a ON a.vin = v.vin
 LEFT JOIN (SELECT * FROM decode_first WHERE src = 'b') b ON b.vin = v.vin
 LEFT JOIN (SELECT * FROM decode_first WHERE src = 'c') c ON c.vin = v.vin),
decode_long AS (
 SELECT vin, 'make' AS field, make_a AS value_a, make_b AS value_b, make_c AS value_c FROM decode_wide
 UNION ALL SELECT vin, 'model', model_a, model_b, model_c FROM decode_wide
 UNION ALL SELECT vin, 'model_year', year_a, year_b, year_c FROM decode_wide)"""

WITH = "WITH " + ", ".join([SALES, CODES, CLEAN, REFERENCES, DATES, JOB, PANELS, DECODERS])

REJECT_SOURCE = """CASE reject_step WHEN 'blank_name' THEN 'name_removed_blanks' WHEN 'email' THEN 'email_rejected'
 WHEN 'address_dedup' THEN 'filtered_out_duplicate_address' WHEN 'sales_type' THEN 'sales_type_rejected'
 WHEN 'geography' THEN 'geo_rejected' WHEN 'business' THEN 'business_rejected' WHEN 'vin' THEN 'vin_rejected'
 WHEN 'model_year' THEN 'vin_rejected' WHEN 'dedup' THEN 'duplicates_rejected' END"""

ELECTRIC = "CASE WHEN regexp_matches(model, '(?i)electric|ev|phev|hybrid') THEN '1' ELSE '0' END"

ADDRESS_ROWS = """SELECT row_id, naddrs1, ncity, nstate,
 row_number() OVER (PARTITION BY naddrs1, ncity, nstate ORDER BY row_id) AS n FROM base"""

VIN_ROWS = """SELECT row_id, vin, row_number() OVER (PARTITION BY vin ORDER BY naddrs1, ncity, nstate, row_id) AS n,
 vin IN (SELECT vin FROM exclusions) AS listed FROM base WHERE length(vin) = 17"""

RULE_LOOKUP = 'SELECT row_id, vin, cell, brand, descr AS "desc", modelid FROM coded'


def _pivot() -> str:
    counts = [
        f"count(*) FILTER (WHERE modyy = {year} AND channel = '{channel}') AS \"Year {year} {channel.title()}\""
        for year in (2023, 2024, 2025, 2026)
        for channel in ("email", "mail")
    ]
    return f"""SELECT cell, description, {", ".join(counts)}, count(*) AS "Total" FROM (
 SELECT CASE WHEN cell = 'DEFAULT' THEN 'UNCODED' ELSE cell END AS cell,
  CASE WHEN cell = 'DEFAULT' THEN 'Uncoded – No Cell Assigned' ELSE descr END AS description, modyy,
  CASE WHEN coalesce(email, '') = '' THEN 'mail' ELSE 'email' END AS channel FROM coded) GROUP BY ALL"""


def _audit() -> str:
    steps = ["blank_name", "email", "address_dedup", "sales_type", "geography", "business", "vin", "model_year", "dedup"]
    values = ", ".join(f"({n}, '{step}')" for n, step in enumerate(steps, 1))
    return f"""SELECT step_no, step, total - before AS records_before, rejected, total - before - rejected AS records_after FROM (
 SELECT step_no, step, rejected, total,
  CAST(coalesce(sum(rejected) OVER (ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
 FROM (SELECT step_no, step, count(reject_step) AS rejected FROM (VALUES {values}) AS s(step_no, step)
  LEFT JOIN tagged ON reject_step = step GROUP BY step_no, step), (SELECT count(*) AS total FROM tagged))"""


def _counters() -> str:
    conditions = {
        "initial_count": "true",
        "invalid_sales_type": "reject_step = 'sales_type'",
        "invalid_model_year": "reject_step = 'model_year'",
        "invalid_emails": "reject_step = 'email'",
        "blank_name": "reject_step = 'blank_name'",
        "duplicate_addresses": "reject_step = 'address_dedup'",
        "bad_state_codes": "reject_reason = 'Invalid state code'",
        "bad_zip_state": "reject_reason = 'State/ZIP mismatch'",
        "geo_rejected": "reject_step = 'geography'",
        "business_exclusions": "reject_step = 'business'",
        "vin_rejected": "reject_step = 'vin'",
        "dedup_removed": "reject_step = 'dedup'",
        "duplicate_vins": "reject_reason = 'Duplicate VIN in file'",
        "listed_vins": "reject_reason = 'Duplicate record'",
        "final_valid_records": "reject_step IS NULL",
        "blank_zip": "zip_code IS NULL",
        "blank_sales_type": "coalesce(trim(veh_acq_type_cd), '') = ''",
        "email_count": "reject_step IS NULL AND coalesce(email, '') <> ''",
        "mail_count": "reject_step IS NULL AND coalesce(email, '') = ''",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, count(*) AS n_rows FROM tagged WHERE {condition}" for name, condition in conditions.items()
    )


def _layout(channel: str, more: str = "") -> str:
    email = ' email AS "EMAIL",' if channel == "email" else ""
    return f"""SELECT name AS "NAME", address_line1 AS "ADDRESS", city AS "CITY", state AS "STATE", zip_code AS "ZIP",
 'A' AS "ROTATION", '1.0' AS "VERSION", 'vehicle_sales' AS "FILE SOURCE", cell AS "SVI CELL", CAST(modyy AS VARCHAR) AS "MOD YR",
 descr AS "DESCRIPTION", vin AS "VIN", CAST(purch_lse AS VARCHAR) AS "PURCH/LSE", mo AS "MO PURCH", yr AS "YR PURCH",
 CAST(NULL AS VARCHAR) AS "MAIL DATE (MMDD)", brand AS "BRAND", CAST(seq8 AS VARCHAR) AS "SEQUENCE #(8)",{email}
 bodycode AS "MFG MODEL CODE", CAST(NULL AS VARCHAR) AS "EXTRA1", ucc AS "UCC", CAST(seq8 AS VARCHAR) AS "EXTERNALREFERENCE",
 electric AS "ELECTRIC", CAST(NULL AS VARCHAR) AS "SOS", domain AS "DOMAIN", '{channel}' AS "CHANNEL"{more}
 FROM final WHERE channel = '{channel}'"""


STATEMENTS = {
    "email_clean": "SELECT row_id, email FROM base",
    "email_verdict": """SELECT row_id, email, CASE WHEN email_reason IS NOT NULL THEN 'email' END AS reject_step,
 email_reason AS reject_reason FROM checked""",
    "zip_normalize": """SELECT row_id, zip_code, substr(zip_code, 1, 2) AS zip2,
 CASE WHEN NOT contains(raw_zip, '-') THEN zip_code END AS strict_zip FROM base""",
    "zip_plus4": """SELECT row_id, substr(trim(raw_zip), 1, 5) AS zip_code5,
 nullif(regexp_extract(trim(raw_zip), '^[0-9]{5}-?([0-9]{4})$', 1), '') AS zip4 FROM base""",
    "zip_counts": """SELECT count(*) FILTER (WHERE coalesce(trim(raw_zip), '') = '') AS blank_zip,
 count(*) FILTER (WHERE trim(raw_zip) <> '' AND NOT regexp_full_match(trim(raw_zip), '[0-9]+')) AS bad_zip FROM base""",
    "text_keys": """SELECT row_id, upper(trim(raw_state)) AS state_key, trim(regexp_replace(
  CASE WHEN first_name IS NOT NULL AND last_name IS NOT NULL THEN first_name || '  ' || last_name END, '\\s+', ' ', 'g')) AS squeezed,
 CASE WHEN raw_vin LIKE '%.0' THEN substr(raw_vin, 1, length(raw_vin) - 2) ELSE raw_vin END AS no_point_zero,
 last_name AS readable FROM base""",
    "name_build": "SELECT row_id, name FROM base",
    "name_build_per_row": "SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'Given ' || city ELSE name END AS name FROM base",
    "blank_name": "SELECT row_id, name, 'blank_name' AS reject_step, 'Blank name' AS reject_reason FROM base WHERE name = ''",
    "sales_type_verdict": """SELECT row_id, veh_acq_type_cd, CASE WHEN lower(trim(veh_acq_type_cd)) = 'lease' THEN 2 ELSE 1 END AS purch_lse,
 CASE WHEN sales_reason IS NOT NULL THEN 'sales_type' END AS reject_step, sales_reason AS reject_reason FROM checked""",
    "sales_type_counts": "SELECT coalesce(lower(trim(veh_acq_type_cd)), 'unknown') AS sales_type, count(*) AS n_rows FROM sales GROUP BY 1",
    "geo_verdict": """SELECT row_id, state, zip_code, CASE WHEN geo_reason IS NOT NULL THEN 'geography' END AS reject_step,
 geo_reason AS reject_reason FROM checked""",
    "geo_reason_counts": """SELECT 'geography' AS reject_step, geo_reason AS reject_reason, count(*) AS n_rows FROM checked
 WHERE geo_reason IS NOT NULL GROUP BY geo_reason""",
    "business_verdict": """SELECT row_id, name, has_term, has_manufacturer, is_allowed,
 (has_term OR has_manufacturer) AND NOT is_allowed AS is_business FROM checked""",
    "vin_clean": "SELECT row_id, vin FROM base",
    "vin_verdict": """SELECT row_id, vin, CAST(modyy AS INTEGER) AS modyy, CASE WHEN NOT vin_ok THEN 'vin' WHEN NOT year_ok THEN 'model_year' END AS reject_step,
 CASE WHEN NOT vin_ok THEN 'Invalid VIN' WHEN NOT year_ok THEN 'Invalid model year' END AS reject_reason FROM checked""",
    "vin_segments": "SELECT row_id, vin13, vin48, vin10 FROM checked WHERE vin_ok",
    "vin_model_year": "SELECT row_id, vin10, CAST(modyy AS INTEGER) AS model_year FROM checked WHERE vin_ok",
    "year_forms": """SELECT row_id, CAST(y AS INTEGER) AS modyy FROM (
 SELECT row_id, CASE WHEN y IS NULL THEN NULL WHEN row_id % 2 = 0 THEN y ELSE '20' || substr(y, 3, 2) END AS y FROM (
  SELECT row_id, strftime(try_strptime(substr(purchase_date, 1, 10), '%Y-%m-%d'), '%Y') AS y FROM sales))""",
    "wmi_brand": """SELECT row_id, vin13, CASE vin13 WHEN 'SAL' THEN 'Land Rover' WHEN 'SAJ' THEN 'Jaguar' ELSE city END AS true_brand
 FROM checked WHERE vin_ok""",
    "vin_length_profile": "SELECT CAST(length(vin) AS INTEGER) AS vin_length, count(*) AS n_rows FROM base GROUP BY 1",
    "ev_flag": f"""SELECT row_id, model, {ELECTRIC} AS electric,
 CASE WHEN regexp_matches(model, '(?i)\\b(electric|ev|phev|hybrid)\\b') THEN '1' ELSE '0' END AS electric_word FROM sales""",
    "ev_listed": """SELECT row_id, vin, CASE WHEN vin IN (SELECT vin FROM sales WHERE row_id % 7 = 1 AND vin IS NOT NULL) THEN '1' ELSE '0' END AS electric
 FROM sales""",
    "purchase_date_parts": """SELECT row_id, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS purchased, strftime(stamp, '%m') AS "MO Purch",
 strftime(stamp, '%Y') AS "YR Purch" FROM dated""",
    "invalid_dates": "SELECT row_id FROM dated WHERE stamp IS NULL",
    "channel_split": "SELECT row_id, CASE WHEN coalesce(email, '') IN ('', 'nan') THEN 'mail' ELSE 'email' END AS channel FROM base",
    "domain_panel": """SELECT row_id, domain, CASE WHEN domain IN ('gmail.com', 'googlemail.com') THEN 'gmail'
  WHEN domain IN ('yahoo.com', 'aol.com', 'ymail.com', 'rocketmail.com') THEN 'yahoo_aol' ELSE 'other' END AS panel,
 CASE WHEN domain = 'gmail.com' THEN 'gmail' WHEN domain IN ('yahoo.com', 'aol.com') THEN 'yahoo/aol' ELSE 'other' END AS coarse_panel
 FROM (SELECT row_id, CASE WHEN contains(email, '@') THEN split_part(email, '@', -1) ELSE 'unknown' END AS domain FROM base)""",
    "domain_counts": "SELECT panel, count(*) AS n_rows FROM panelled GROUP BY panel",
    "address_dedup_kept": f"SELECT row_id, naddrs1, ncity, nstate FROM ({ADDRESS_ROWS}) WHERE n = 1",
    "address_dedup_rejected": f"""SELECT row_id, naddrs1, ncity, nstate, 'Filter_Duplicate_Address' AS drop_reason
 FROM ({ADDRESS_ROWS}) WHERE n > 1""",
    "address_dedup_blanks_apart": f"""SELECT row_id FROM base WHERE row_id % 3 = 0 UNION ALL SELECT row_id FROM (
 {ADDRESS_ROWS} WHERE row_id % 3 <> 0) WHERE n = 1""",
    "address_dup_groups": """SELECT address_line1, city, state, zip_code, count(*) AS n_rows FROM sales
 WHERE address_line1 IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL AND zip_code IS NOT NULL
 GROUP BY ALL HAVING count(*) > 1""",
    "vin_dedup": f"""SELECT row_id, vin, CASE WHEN n > 1 THEN 'Duplicate VIN in file' WHEN listed THEN 'Duplicate record' END AS dedup_reason
 FROM ({VIN_ROWS})""",
    "exclusion_hits": f"SELECT row_id FROM ({VIN_ROWS}) WHERE n = 1 AND listed",
    "exclusion_hits_by_source": """SELECT b.row_id, b.vin, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM base b JOIN (
 SELECT vin, unnest(['earlier', 'earlier again']) AS source FROM base WHERE row_id % 11 = 0 UNION ALL SELECT vin, 'other' FROM base WHERE row_id % 13 = 0
 UNION ALL SELECT vin, 'third' FROM base WHERE row_id % 26 = 0) USING (vin) WHERE length(b.vin) = 17 GROUP BY b.row_id, b.vin""",
    "exclusion_set": "SELECT vin FROM exclusions",
    "vin_rule_lookup": RULE_LOOKUP,
    "vin_rule_lookup_large": RULE_LOOKUP,
    "brand_relookup": """SELECT row_id, coalesce(r.brand, '') AS "Brand", coalesce(r.descr, '') AS "Description" FROM checked c
 LEFT JOIN (SELECT * FROM rules QUALIFY row_number() OVER (PARTITION BY vin13, vin48, vin10 ORDER BY ord) = 1) r
  ON r.vin13 = c.vin13 AND r.vin48 = c.vin48 AND r.vin10 = c.vin10 WHERE vin_ok""",
    "default_cell_report": """SELECT vin, vin13, vin48, vin10, bodycode, cell, model, first_name, last_name, address_line1, city, state,
 zip_code, brand, descr AS "desc" FROM coded WHERE cell = 'DEFAULT'""",
    "ucc_missing": """SELECT DISTINCT upper(c.cell) AS cell, CAST(c.modyy AS INTEGER) AS modyy FROM coded c
 WHERE NOT EXISTS (SELECT 1 FROM ucc_master u WHERE u.cell = upper(c.cell) AND u.modyy = c.modyy)""",
    "ucc_enrich": """SELECT row_id, cell, CAST(modyy AS INTEGER) AS modyy, ucc,
 CASE WHEN regexp_full_match(ucc, '[0-9]{21}') THEN '="' || ucc || '"' ELSE ucc END AS ucc_text FROM with_ucc""",
    "ucc_unmatched": "SELECT DISTINCT cell, CAST(modyy AS INTEGER) AS modyy FROM with_ucc WHERE ucc = 'MISSING_UCC'",
    "ucc_upsert": """SELECT cell, modyy, ucc, description FROM ucc_master
  QUALIFY row_number() OVER (PARTITION BY cell, modyy ORDER BY ord DESC) = 1
 UNION ALL SELECT DISTINCT upper(c.cell), CAST(c.modyy AS INTEGER), 'PENDING', 'PENDING DESCRIPTION' FROM coded c
 WHERE NOT EXISTS (SELECT 1 FROM ucc_master u WHERE u.cell = upper(c.cell) AND u.modyy = c.modyy)""",
    "desc_enrich": "SELECT row_id, cell, description_long FROM with_desc",
    "desc_missing": "SELECT DISTINCT cell FROM with_desc WHERE description_long = 'MISSING DESCRIPTION'",
    "sequence_numbers": "SELECT row_id, 500 + row_number() OVER (ORDER BY naddrs1, ncity, nstate, row_id) AS seq8 FROM base",
    "panel_chunks": "SELECT row_id, panel, panel_row, (panel_row - 1) // 4500 + 1 AS chunk, n_chunks FROM chunked",
    "panel_sizes": """SELECT panel, n_chunks, (panel_row - 1) // 4500 + 1 AS chunk, count(*) AS n_rows FROM chunked GROUP BY ALL""",
    "vin_batches": """SELECT vin, row_number() OVER (ORDER BY vin) AS vin_row, (row_number() OVER (ORDER BY vin) - 1) // 1000 + 1 AS batch
 FROM (SELECT DISTINCT vin FROM base WHERE length(vin) = 17)""",
    "full_job": """SELECT row_id, seq8, name, email, zip_code, vin, CAST(modyy AS INTEGER) AS modyy, true_brand, cell, brand, descr AS "desc",
 modelid, ucc, electric, description_long, mo AS "MO Purch", yr AS "YR Purch", channel, panel, panel_row, purch_lse FROM final""",
    "reject_report": f"""SELECT row_id, reject_step, reject_reason, {REJECT_SOURCE} AS rejection_source FROM tagged
 WHERE reject_step IS NOT NULL""",
    "reject_reason_counts": """SELECT reject_step, reject_reason, count(*) AS n_rows FROM tagged WHERE reject_step IS NOT NULL
 GROUP BY ALL""",
    "step_audit": _audit(),
    "reconciliation": """SELECT count(*) AS start_count, count(reject_step) AS total_removed, count(*) - count(reject_step) AS final_count,
 count(*) - count(reject_step) AS expected_final, 'Match' AS status FROM tagged""",
    "run_counters": _counters(),
    "vin_profile": """SELECT CAST(length AS INTEGER) AS length, class, sum(n_rows) AS n_rows,
 coalesce(array_to_string(list_slice(list(value ORDER BY digest) FILTER (WHERE value IS NOT NULL), 1, 3), ' '), '') AS samples FROM (
 SELECT length(vin) AS length, CASE WHEN vin IS NULL THEN 'null' WHEN trim(vin) = '' THEN 'blank' WHEN regexp_full_match(vin, '[0-9]+') THEN 'digits'
  WHEN regexp_full_match(vin, '[A-Za-z]+') THEN 'letters' WHEN regexp_full_match(vin, '[A-Za-z0-9]+') THEN 'letters and digits' ELSE 'other' END AS class,
  count(*) AS n_rows, min(md5(vin)) AS digest, arg_min(vin, md5(vin)) AS value FROM sales GROUP BY 1, 2, substr(md5(vin), 1, 1)) GROUP BY ALL""",
    "domain_breakdown": """SELECT CASE WHEN strpos(email, '@') > 0 THEN split_part(email, '@', -1) ELSE 'unknown' END AS domain, count(*) AS n_rows,
 count(CASE WHEN reject_step IS NULL THEN 1 END) AS n_kept FROM tagged WHERE coalesce(email, '') <> '' GROUP BY 1""",
    "sales_type_breakdown": """SELECT coalesce(nullif(lower(trim(veh_acq_type_cd)), ''), 'unknown') AS sales_type, count(*) AS n_rows,
 count(CASE WHEN reject_step IS NULL THEN 1 END) AS n_kept FROM tagged GROUP BY 1""",
    "final_in_order": """SELECT row_number() OVER (ORDER BY seq8) AS n, CAST(row_id AS VARCHAR) AS record, CAST(seq8 AS VARCHAR) AS "EXTERNALREFERENCE",
 email AS "EMAIL" FROM final""",
    "panel_file_index": """SELECT 'acme_06_2025_' || panel || '_panel_' || CAST(chunk AS VARCHAR) || '_of_' || CAST(of AS VARCHAR) || '.csv' AS name, panel, chunk, n_rows
 FROM (SELECT panel, chunk, count(*) AS n_rows, max(chunk) OVER (PARTITION BY panel) AS of FROM (
  SELECT panel, (row_number() OVER (PARTITION BY panel ORDER BY seq8) - 1) // 100 + 1 AS chunk FROM final WHERE channel = 'email') GROUP BY panel, chunk)""",
    "cellcode_pivot": _pivot(),
    "panel_totals": "SELECT channel, count(*) AS n_rows FROM kept GROUP BY channel",
    "final_table": """SELECT row_id, email AS "EMAIL", domain AS "DOMAIN", bodycode AS "MFG MODEL CODE", 'A' AS "ROTATION", '1.0' AS "VERSION",
 'vehicle_sales' AS "FILE SOURCE", seq8 AS "EXTERNALREFERENCE", CAST(NULL AS VARCHAR) AS "PHONE", brand AS "Brand", descr AS "Description" FROM final""",
    "panel_layout_email": _layout("email"),
    "panel_layout_mail": _layout("mail"),
    "panel_files": _layout(
        "email",
        """, panel || '_panel_' || CAST((panel_row - 1) // 4500 + 1 AS VARCHAR) || '_of_'
 || CAST(CAST(ceil(count(*) OVER (PARTITION BY panel) / 4500.0) AS BIGINT) AS VARCHAR) AS panel_file, panel_row""",
    ),
    "vin_prepare": "SELECT DISTINCT vin FROM base WHERE length(vin) = 17",
    "vin_problems": """SELECT row_id, raw_vin AS vin, CASE WHEN coalesce(vin, '') = '' THEN 'Blank VIN' WHEN length(vin) <> 17 THEN 'Invalid VIN'
 ELSE 'Unknown year code' END AS reason FROM clean WHERE coalesce(length(vin), 0) <> 17 OR modyy IS NULL""",
    "vin_decode": """SELECT c.vin, coalesce(r.brand, '') AS make, coalesce(r.descr, '') AS model, CAST(c.modyy AS INTEGER) AS model_year,
  coalesce(r.cell, 'DEFAULT') AS cell
 FROM (SELECT DISTINCT vin, vin13, vin48, vin10, modyy FROM clean WHERE length(vin) = 17) c
 LEFT JOIN (SELECT * FROM own_rules WHERE m = '') r ON r.vin13 = c.vin13 AND r.vin48 = c.vin48 AND r.vin10 = c.vin10""",
    "unify_sources": """SELECT vin, coalesce(make_a, make_b, make_c) AS make, coalesce(model_a, model_b, model_c) AS model,
 coalesce(year_a, year_b, year_c) AS model_year FROM decode_wide""",
    "source_conflicts": """SELECT vin, field, CAST(len(list_distinct(list_filter([value_a, value_b, value_c], lambda x: x IS NOT NULL))) AS INTEGER) AS n_values,
 value_a, value_b, value_c FROM decode_long
 WHERE len(list_distinct(list_filter([value_a, value_b, value_c], lambda x: x IS NOT NULL))) > 1""",
    "main_secondary_merge": """SELECT row_id, vin, make, model, model_year FROM decode_all WHERE src IN ('b', 'c')
 QUALIFY row_number() OVER (PARTITION BY vin ORDER BY src, row_id) = 1""",
    "column_aliases": """SELECT row_id, CASE WHEN row_id % 2 = 0 THEN raw_zip END AS "ZIP", coalesce(bodycode, model) AS bodycode,
 raw_vin AS "SVI CELL", city FROM base""",
    "address_consolidation": """SELECT row_id, trim(regexp_replace(concat_ws(' ', address_line1, 'Unit ' || city), '\\s+', ' ', 'g')) AS split_line,
 trim(regexp_replace(concat_ws(' ', 'No 7', address_line1), '\\s+', ' ', 'g')) AS house_line FROM sales""",
    "contact_columns": """SELECT row_id, CASE WHEN row_id % 4 = 0 THEN raw_vin WHEN row_id % 3 = 0 THEN city END AS phone,
 coalesce(CASE WHEN row_id % 5 = 0 THEN model END, raw_state) AS extra1, bodycode AS modelid FROM base""",
    "csv_scan": """SELECT row_id, vin, state, zip_code, CAST(NULL AS VARCHAR) AS extra1 FROM sales""",
    "positional_columns": "SELECT CAST(row_id AS VARCHAR) AS row_id, vin, state AS col2, CAST(NULL AS VARCHAR) AS extra1 FROM sales",
    "csv_layout": "SELECT CAST(row_id AS VARCHAR) AS row_id, vin, zip_code FROM sales",
    "csv_mixed_encoding": "SELECT CAST(row_id AS VARCHAR) AS row_id, 'José Müller ' || CAST(row_id AS VARCHAR) AS name FROM sales",
    "csv_good_lines": """SELECT CAST(row_id AS VARCHAR) AS row_id, CASE WHEN row_id % 17 <> 0 THEN 'x,"y"' END AS middle,
 CASE WHEN row_id % 17 <> 0 THEN 'z' END AS "last" FROM sales WHERE row_id % 13 <> 0""",
    "csv_bad_lines": """SELECT CAST(row_id AS VARCHAR) || ',"a,b",c,d' AS bad_line FROM sales WHERE row_id % 13 = 0""",
    "quoted_line_breaks": """SELECT CAST(row_id AS VARCHAR) AS row_id, CASE WHEN row_id % 3 = 0 THEN 'Zürich' || chr(10) || ', "' || CAST(row_id AS VARCHAR)
 || '"' || chr(10) || chr(10) || 'end' WHEN row_id % 3 = 1 THEN '5" pipe' END AS note, city FROM sales""",
    "mixed_headers": """SELECT CAST(row_id AS VARCHAR) AS row_id, vin AS "VIN", CASE WHEN row_id % 3 < 2 THEN zip_code END AS zip,
 CASE WHEN row_id % 3 = 2 THEN state END AS st FROM sales""",
    "positional_bad_lines": """SELECT line_no, 'quote not closed' AS reason, CAST(row_id AS VARCHAR) || ',",' || vin AS line FROM (
 SELECT row_id, vin, row_number() OVER (ORDER BY row_id) AS line_no FROM sales) WHERE row_id % 7 = 0""",
    "positional_records": """SELECT CAST(row_id AS VARCHAR) AS row_id, vin, '5" x' AS col2 FROM sales WHERE row_id % 7 <> 0""",
    "ingest_columns": """SELECT row_id, CAST(row_id AS VARCHAR) AS order_no, first_name,
 nullif(trim(regexp_replace(concat_ws(' ', address_line1, CASE WHEN state = 'TX' THEN ' Unit ' || CAST(row_id AS VARCHAR) END), '\\s+', ' ', 'g')), '') AS address_line1,
 CASE WHEN state = 'TX' THEN ' Unit ' || CAST(row_id AS VARCHAR) END AS address_line2, zip_code AS zip, vin AS bodycode,
 vin AS usa_vin, email_addr, city, nullif(state, '') AS state, purchase_date,
 CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS extra1 FROM sales""",
    "exclusion_files": "SELECT vin FROM exclusions",
    "master_scan": "SELECT CAST(ord AS BIGINT) AS ord, cell, modyy, nullif(ucc, '') AS ucc FROM ucc_master",
}


#: Rows that ``audit_with_bad_lines`` writes as lines no scan can read.
UNREADABLE = "row_id % 97 = 0 OR row_id % 101 = 0"


def _audit_with_bad_lines() -> str:
    """The audit of the readable rows, after a step that takes the others."""
    readable = SALES.replace("sales AS (", "every AS (", 1) + f", sales AS (SELECT * FROM every WHERE NOT ({UNREADABLE}))"
    lost = f"(SELECT count(*) FROM every WHERE {UNREADABLE})"
    return f"""{WITH.replace(SALES, readable, 1)}
SELECT 0 AS step_no, 'unreadable_line' AS step, (SELECT count(*) FROM every) AS records_before, {lost} AS rejected, (SELECT count(*) FROM sales) AS records_after
UNION ALL {_audit()}"""


def oracle_sql() -> dict[str, str]:
    found = {name: f"{WITH}\n{statement}" for name, statement in STATEMENTS.items()}
    return found | {"audit_with_bad_lines": _audit_with_bad_lines()}
