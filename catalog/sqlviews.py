"""The analysis tables of ``tidemark.plans.views`` written again as DuckDB SQL, for the result check."""

from __future__ import annotations

import re


def expand(sql: str) -> str:
    """Replace ``ph(x)`` by the portable hash: the first 15 hex digits of md5 as BIGINT."""
    out, i = [], 0
    for m in iter(lambda: re.compile(r"\bph\(").search(sql, i), None):
        out.append(sql[i : m.start()])
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out.append(f"('0x'||substr(md5({expand(sql[m.end():j - 1])}),1,15))::BIGINT")
        i = j
    return "".join(out) + sql[i:]


TEXT_HASH = r"md5(trim(regexp_replace(lower(COALESCE(text,'')), '[\t\n\f\r ]+', ' ', 'g')))"
# Runs of letters outside of tags, one space between them.
LOOSE = "array_to_string(regexp_extract_all(regexp_replace(lower(COALESCE(text,'')), '<[^>]*>', ' ', 'g'), '[a-z]+'), ' ')"

VIEWS: dict[str, str] = {}

VIEWS["line"] = """
SELECT l_orderkey||'|'||l_linenumber||'|'||l_partkey||'|'||l_suppkey||'|'||CAST(CAST(l_shipdate AS DATE) AS VARCHAR)
         ||'|'||CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS k,
       1 + CAST(floor((l_quantity-1)/10) AS INT) AS r0, *
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey"""

VIEWS["copied"] = """
SELECT *, 0 AS copy FROM line UNION ALL SELECT *, 1 FROM line WHERE ph('d'||k)%50=0
UNION ALL SELECT *, 2 FROM line WHERE ph('v'||k)%50=0 UNION ALL SELECT *, 3 FROM line WHERE ph('c'||k)%100=0"""

VIEWS["worded"] = """
SELECT *, 'The '||p_name||' by '||p_brand||' in the '||p_type||' line came as '||o_orderpriority
   ||CASE WHEN ph('t'||k)%10<8 THEN ' under order '||l_orderkey ELSE '' END||': '
   ||(['terrible, it broke at once','bad and it stopped working','okay, not much to add','good value for the money',
       'great, I love it'])[1+CASE WHEN ph('s'||k)%10<8 THEN r0-1 ELSE ph('q'||k)%5 END] AS words FROM copied"""

VIEWS["raw_reviews"] = r"""
SELECT k||'#'||copy AS item_key,
  CAST(CASE WHEN ph('z'||k)%500=0 THEN 0 WHEN copy=3 THEN 6-r0 ELSE r0 END AS DOUBLE) AS rating, p_name AS title,
  CASE WHEN ph('n'||k)%400=0 THEN '' WHEN ph('n'||k)%400=1 THEN NULL WHEN ph('n'||k)%400=2 THEN substr(words,1,50)
       WHEN ph('m'||k)%200=0 THEN 'Thank you for this purchase, stock sentence of the seller number '||(ph('e'||k)%8)
       WHEN ph('m'||k)%200=1 THEN 'I was asked to leave these words, stock sentence of the brand number '||(ph('e'||k)%30)
       WHEN ph('w'||k)%7=0 THEN replace(words,' ','  ')||chr(10)
       WHEN ph('b'||k)%11=0 THEN '<b>'||words||'</b> !!'
       WHEN ph('x'||k)%13=0 THEN upper(words) ELSE words END AS text,
  'P'||CASE WHEN copy=3 THEN l_partkey+1 ELSE l_partkey END AS parent_asin,
  'P'||CASE WHEN copy=3 THEN l_partkey+1 ELSE l_partkey END||'-'||CASE WHEN copy=2 THEN (l_suppkey+1)%4 ELSE l_suppkey%4 END AS asin,
  'U'||o_custkey AS user_id,
  CAST(CAST(l_shipdate AS DATE)-DATE '1970-01-01' AS BIGINT)*86400000 + CAST(l_linenumber AS BIGINT)*3600000 AS ts,
  CAST(l_linenumber + (copy=1)::INT AS BIGINT) AS helpful_vote, l_linestatus='F' AS verified_purchase,
  CAST(l_suppkey%3 AS INT) AS n_images
FROM worded"""

VIEWS["reviews"] = rf"""
SELECT *, {TEXT_HASH} AS text_hash, CAST(length(COALESCE(text,'')) AS INT) AS text_len, CAST(year(epoch_ms(ts)) AS INT) AS yr
FROM raw_reviews"""

VIEWS["meta"] = """
SELECT 'P'||p_partkey AS parent_asin, p_type AS main_category,
  CASE WHEN ph('a'||p_partkey)%20=0 THEN ['Catalog'] WHEN ph('a'||p_partkey)%20=1 THEN ['Catalog','',p_name]
       ELSE ['Catalog',p_brand,p_name] END AS categories,
  CAST(1+p_size%5 AS DOUBLE) AS average_rating, CAST(p_size+copy AS BIGINT) AS rating_number
FROM part, (SELECT unnest([0,1]) AS copy) WHERE ph('l'||p_partkey)%20<>0 AND (copy=0 OR ph('2'||p_partkey)%50=0)"""

VIEWS["cats"] = """
SELECT parent_asin, any_value(COALESCE(NULLIF(categories[2],''),'(none)')) AS cat_l1,
  any_value(COALESCE(NULLIF(categories[3],''),'(none)')) AS cat_l2, any_value(main_category) AS main_category
FROM meta GROUP BY parent_asin"""

VIEWS["pool"] = """
SELECT md5(user_id||'|'||asin||'|'||ts||'|'||text_hash) AS item_id, user_id, asin, ts, text_hash, helpful_vote, rating,
  parent_asin, text, text_len, verified_purchase, yr, CAST(month(epoch_ms(ts)) AS INT) AS month,
  CASE WHEN rating<=2 THEN 0 WHEN rating=3 THEN 1 ELSE 2 END AS y
FROM reviews WHERE rating BETWEEN 1 AND 5 AND text_len>0 AND yr BETWEEN 1995 AND 2001
QUALIFY row_number() OVER (PARTITION BY user_id, asin, ts, text_hash
  ORDER BY helpful_vote DESC, rating DESC, parent_asin DESC, text DESC, verified_purchase DESC)=1"""

VIEWS["pool_train"] = "SELECT * FROM pool WHERE yr BETWEEN 1995 AND 1996 AND ph(item_id)%10<8"

VIEWS["prior"] = "SELECT y, count(*)/sum(count(*)) OVER () AS prior FROM pool_train GROUP BY y"

VIEWS["train_sample"] = "SELECT * FROM pool_train ORDER BY ph('42:'||item_id), item_id LIMIT 2000"

VIEWS["natural_tests"] = """
SELECT * FROM (SELECT *, CASE WHEN yr<=1996 AND ph(item_id)%10>=8 THEN 'test_1995-1996_holdout'
    WHEN yr>=1997 THEN 'test_'||yr||'_natural' END AS sample FROM pool) WHERE sample IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY sample ORDER BY ph('7:'||item_id), item_id)<=500"""

VIEWS["matched_tests"] = """
SELECT * EXCLUDE (prior), 'test_'||yr||'_matched' AS sample FROM pool JOIN prior USING (y) WHERE yr>=1997
QUALIFY row_number() OVER (PARTITION BY yr, y ORDER BY ph((7+y)||':'||item_id), item_id)<=round(500*prior)"""

VIEWS["test_samples"] = """
SELECT sample, item_id, yr, y FROM natural_tests UNION ALL SELECT sample, item_id, yr, y FROM matched_tests"""

VIEWS["recent_train"] = """
SELECT * FROM pool WHERE yr BETWEEN 1999 AND 2000 AND item_id NOT IN (SELECT item_id FROM test_samples)
ORDER BY ph('42:'||item_id), item_id LIMIT 2000"""

VIEWS["samples"] = """
SELECT 'train_seed42' AS sample, item_id, yr, y FROM train_sample UNION ALL SELECT * FROM test_samples
UNION ALL SELECT 'train_1999_2000', item_id, yr, y FROM recent_train"""

VIEWS["runs"] = """
SELECT * FROM (VALUES ('big','early',820,-25),('small','early',760,-15),('big','recent',840,-10),('small','recent',800,-5))
  t(model,train_set,a,d), (VALUES (42),(43),(44)) s(seed)"""

VIEWS["preds"] = """
SELECT model, train_set, seed, yr||'_natural' AS test_set, item_id, yr, month, y, pred,
  CASE (pred+3)%3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.1 ELSE 0.3 END::DOUBLE AS p_neg,
  CASE (pred+2)%3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.1 ELSE 0.3 END::DOUBLE AS p_neu,
  CASE (pred+1)%3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.1 ELSE 0.3 END::DOUBLE AS p_pos, user_id, parent_asin
FROM (SELECT *, CAST(CASE WHEN ph(key)%1000 < a+d*(yr-1997) THEN y ELSE (y+1+ph('e'||key)%2)%3 END AS INT) AS pred
  FROM (SELECT *, model||'|'||train_set||'|'||seed||'|'||item_id AS key FROM pool, runs WHERE yr BETWEEN 1997 AND 2001))"""

VIEWS["zero_shot"] = """
SELECT item_id, yr, y, (['NEGATIVE','NEUTRAL','POSITIVE'])[1+CASE WHEN ph('zs'||item_id)%100<66 THEN y ELSE (y+1)%3 END] AS label
FROM pool WHERE yr BETWEEN 1997 AND 2001
QUALIFY row_number() OVER (PARTITION BY yr ORDER BY ph('2026:'||item_id), item_id)<=400"""

VIEWS["docs"] = f"""
SELECT *, {TEXT_HASH} AS text_hash, CAST(length(COALESCE(text,'')) AS INT) AS text_len FROM (
 SELECT doc_id*2+copy AS doc_id, CASE WHEN copy=1 THEN '<b>'||text||'</b> 123' ELSE text END AS text, lang, source,
  CAST(2013+doc_id%11 AS INT) AS yr, CASE lang WHEN 'en' THEN 2 WHEN 'es' THEN 1 ELSE 0 END AS y,
  'U'||(doc_id%211) AS user_id, source AS parent_asin
 FROM documents, (SELECT unnest([0,1]) AS copy) WHERE copy=0 OR doc_id%10=3)"""

VIEWS["rated_items"] = """
SELECT doc_id AS item_id, base, CAST(2+ph('s'||doc_id)%3 AS INT) AS rating_star, yr,
  CASE WHEN yr<=2016 THEN 'early' WHEN yr BETWEEN 2019 AND 2022 THEN 'late' END AS period, source AS cat_l1,
  CAST(length(text) AS INT) AS text_len, CASE base WHEN 'UNCLEAR' THEN 'NEUTRAL' ELSE base END AS gold,
  CASE WHEN doc_id%3=0 THEN 'True' ELSE 'False' END AS verified, CAST(ph('h'||doc_id)%20 AS INT) AS helpful_vote
FROM (SELECT *, CASE WHEN ph('b'||doc_id)%100 < 30+4*(yr-2013) THEN 'NEGATIVE'
    ELSE (['POSITIVE','MIXED','NEUTRAL','UNCLEAR'])[1+ph('o'||doc_id)%4] END AS base
  FROM (SELECT *, CAST(2013+doc_id%11 AS INT) AS yr FROM documents))"""

VIEWS["raters"] = """
SELECT item_id, rater, CASE WHEN ph('k'||rater||':'||item_id)%100<acc THEN base
    ELSE (['POSITIVE','NEGATIVE','MIXED','NEUTRAL','UNCLEAR'])[1+ph('r'||rater||':'||item_id)%5] END AS label
FROM rated_items, (VALUES ('rater_a',75),('rater_b',80),('rater_c',85)) t(rater,acc)
WHERE ph('miss'||rater||':'||item_id)%50<>0"""

VIEWS["rater_log"] = """
SELECT 'items' AS source, rater AS model, item_id, CASE try WHEN 2 THEN label WHEN 1 THEN 'UNCLEAR' END AS label,
  CASE WHEN try=0 THEN 'unparseable' END AS error, '2024-01-01T00:00:0'||try AS utc
FROM (SELECT *, unnest(CASE WHEN u<2 THEN [0,2] WHEN u=2 THEN [1,2] WHEN u=3 THEN [0] ELSE [2] END) AS try
  FROM (SELECT *, ph('log'||rater||':'||item_id)%20 AS u FROM raters))"""

VIEWS["replies"] = """
SELECT rater, item_id, label, ph('raw'||item_id)%6 AS u FROM raters"""

VIEWS["aspects"] = """
SELECT doc_id AS sentence_id, list_transform(list_filter([0,1,2], lambda i: i < ph('cnt'||doc_id)%4),
  lambda i: (['positive','negative','neutral','conflict'])[1+(least(ph('pol'||i||':'||doc_id)%7,6)%4)]) AS polarities FROM documents"""

VIEWS["complete"] = """
SELECT * FROM raters WHERE item_id IN (SELECT item_id FROM raters GROUP BY item_id HAVING count(DISTINCT rater)=3)"""

VIEWS["votes"] = """
SELECT item_id, CASE WHEN 2*max(c)<=sum(c) THEN 'NO_MAJORITY' ELSE arg_max(label,c) END AS majority, max(c)=sum(c) AS unanimous
FROM (SELECT item_id, label, count(*) AS c FROM complete GROUP BY ALL) GROUP BY item_id"""

VIEWS["voted"] = "SELECT * FROM rated_items JOIN votes USING (item_id)"

VIEWS["annotation"] = """
SELECT * EXCLUDE (rn), 'R'||lpad(CAST(row_number() OVER (ORDER BY ph('shuffle99:'||item_key), item_key)-1 AS VARCHAR),5,'0') AS item_id
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, asin, ts ORDER BY ph('99:'||item_key), item_key) AS rn FROM (
  SELECT *, CAST(rating AS INT) AS rating_star FROM reviews WHERE rating IN (2,3,4) AND text_len BETWEEN 20 AND 2000
  QUALIFY row_number() OVER (PARTITION BY rating, yr ORDER BY ph('99:'||item_key), item_key) <= CASE WHEN rating=3 THEN 29 ELSE 15 END))
WHERE rn=1"""

VIEWS["f1_runs"] = """
SELECT model, train_set, seed, yr, 2.0*c0/t0 AS f0, 2.0*c1/t1 AS f1, 2.0*c2/t2 AS f2, (2.0*c0/t0+2.0*c1/t1+2.0*c2/t2)/3.0 AS macro_f1
FROM (SELECT model, train_set, seed, yr,
  sum((y=0 AND pred=0)::INT)::DOUBLE c0, sum((y=0)::INT+(pred=0)::INT)::DOUBLE t0,
  sum((y=1 AND pred=1)::INT)::DOUBLE c1, sum((y=1)::INT+(pred=1)::INT)::DOUBLE t1,
  sum((y=2 AND pred=2)::INT)::DOUBLE c2, sum((y=2)::INT+(pred=2)::INT)::DOUBLE t2 FROM preds GROUP BY ALL)"""


def needed(sql: str) -> list[str]:
    """Views a query uses, in order of definition."""
    found: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"(?<![\w.'_]){name}(?![\w'(])", text):
                found.add(name)
                visit(VIEWS[name])

    visit(sql)
    return [v for v in VIEWS if v in found]


def compose(sql: str, extra: dict[str, str] | None = None) -> str:
    """A complete statement: the views it needs as common table expressions, then the query."""
    ctes = [f"{v} AS MATERIALIZED ({VIEWS[v].strip()})" for v in needed(sql + " ".join((extra or {}).values()))]
    ctes += [f"{k} AS MATERIALIZED ({v.strip()})" for k, v in (extra or {}).items()]
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return expand(head + sql.strip())
