-- view: v_segments both
SELECT conv_id AS source, turn AS seg_no, CAST(turn * 10 AS DOUBLE) AS start_s,
       CAST(turn * 10 + least(9, greatest(1, CAST(floor(length(text) / 100.0) AS BIGINT))) AS DOUBLE) AS end_s,
       role, text
FROM conversations
-- view: v_energy spark
WITH span AS (SELECT source, CAST(max(end_s) AS BIGINT) AS n FROM v_segments GROUP BY source),
     secs AS (SELECT source, explode(sequence(CAST(0 AS BIGINT), n - 1)) AS sec FROM span)
SELECT s.source, s.sec,
       CAST(coalesce((length(g.text) * 31 + s.sec * 17) % 97 + 1, 0) AS DOUBLE) AS rms
FROM secs s LEFT JOIN v_segments g ON g.source = s.source AND s.sec >= g.start_s AND s.sec < g.end_s
-- view: v_energy duckdb
WITH span AS (SELECT source, CAST(max(end_s) AS BIGINT) AS n FROM v_segments GROUP BY source),
     secs AS (SELECT source, unnest(range(0, n)) AS sec FROM span)
SELECT s.source, s.sec,
       CAST(coalesce((length(g.text) * 31 + s.sec * 17) % 97 + 1, 0) AS DOUBLE) AS rms
FROM secs s LEFT JOIN v_segments g ON g.source = s.source AND s.sec >= g.start_s AND s.sec < g.end_s
-- view: v_signal spark
SELECT user_id AS source, event_type AS track,
       CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 3600000000) AS BIGINT) AS sec, value AS amp
FROM events
-- view: v_signal duckdb
SELECT user_id AS source, event_type AS track, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS sec, value AS amp
FROM events
-- view: v_words spark
SELECT source, seg_no, CAST(p AS BIGINT) AS word_no, w AS word,
       start_s + p * (end_s - start_s) / n AS start_s, start_s + (p + 1) * (end_s - start_s) / n AS end_s
FROM (SELECT *, size(split(text, ' ')) AS n FROM v_segments) t LATERAL VIEW posexplode(split(text, ' ')) e AS p, w
-- view: v_words duckdb
SELECT source, seg_no, CAST(p AS BIGINT) AS word_no, w AS word,
       start_s + p * (end_s - start_s) / n AS start_s, start_s + (p + 1) * (end_s - start_s) / n AS end_s
FROM (SELECT *, len(string_split(text, ' ')) AS n, unnest(string_split(text, ' ')) AS w,
             generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM v_segments) t
-- view: v_moments both
SELECT concat('s', CAST(source AS VARCHAR(20)), '_', CAST(seg_no AS VARCHAR(20))) AS id, source, start_s, end_s, 'speech' AS type,
       CAST(length(text) AS DOUBLE) / 10 AS intensity, start_s + length(text) % 3 AS peak, text
FROM v_segments
UNION ALL
SELECT concat('a', CAST(source AS VARCHAR(20)), '_', CAST(seg_no AS VARCHAR(20))), source, start_s + 1, end_s + 3, 'audio_spike',
       CAST(length(text) % 120 AS DOUBLE) / 10, start_s + 2, ''
FROM v_segments WHERE seg_no % 3 = 0
-- view: v_posted both
SELECT source, start_s + 4 AS start_s, end_s + 4 AS end_s FROM v_segments WHERE seg_no % 4 = 3
-- view: v_clips both
SELECT source * 1000 + seg_no AS clip_id, source, greatest(0.0, start_s - 4) AS start_s, end_s + 4 AS end_s,
       start_s + 2 AS peak, CAST(length(text) % 101 AS DOUBLE) AS score
FROM v_segments WHERE length(text) >= 300
-- view: v_played both
SELECT clip_id, start_s, 0 AS k, CAST(5 AS DOUBLE) AS a, CAST(7 AS DOUBLE) AS b FROM v_clips
UNION ALL SELECT clip_id, start_s, 1, CAST(0 AS DOUBLE), CAST(6 AS DOUBLE) FROM v_clips
UNION ALL SELECT clip_id, start_s, 2, CAST(8 AS DOUBLE), CAST(8 + 2 + clip_id % 5 AS DOUBLE) FROM v_clips
-- view: v_candidates spark
SELECT doc_id AS clip_id, CAST(p AS BIGINT) AS pos, trim(c) AS text
FROM documents LATERAL VIEW posexplode(split(text, '[.\\n]')) e AS p, c
WHERE length(trim(c)) > 0
-- view: v_candidates duckdb
SELECT clip_id, CAST(p AS BIGINT) AS pos, trim(c) AS text
FROM (SELECT doc_id AS clip_id, unnest(regexp_split_to_array(text, '[.\n]')) AS c,
             generate_subscripts(regexp_split_to_array(text, '[.\n]'), 1) - 1 AS p FROM documents) t
WHERE length(trim(c)) > 0
-- view: v_rule_lines spark
SELECT source AS campaign, doc_id, CAST(p AS BIGINT) AS line_no, trim(c) AS text
FROM documents LATERAL VIEW posexplode(split(text, '\\n')) e AS p, c WHERE length(trim(c)) > 0
-- view: v_rule_lines duckdb
SELECT campaign, doc_id, CAST(p AS BIGINT) AS line_no, trim(c) AS text
FROM (SELECT source AS campaign, doc_id, unnest(string_split(text, chr(10))) AS c,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents) t WHERE length(trim(c)) > 0
-- view: v_briefs both
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE concat('# Campaign ', coalesce(source, ''), chr(10), '## On-modal requirements / guidelines', chr(10), CASE WHEN doc_id % 4 = 1 THEN '(none on the modal)' ELSE substr(coalesce(text, ''), 1, 90) END, chr(10),
         '### Detail', chr(10), substr(coalesce(text, ''), 91, CAST(60 + doc_id % 90 AS INTEGER)), chr(10), '## Rules text (scout detail extraction)', chr(10), CASE WHEN doc_id % 4 = 2 THEN 'See the linked doc below.' ELSE '(NONE)' END, chr(10), '## Other', chr(10), coalesce(text, '')) END AS text
FROM documents
-- view: v_brief_lines spark
SELECT campaign, CAST(0 AS BIGINT) AS doc_id, CAST(p AS BIGINT) AS line_no, c AS text FROM (SELECT p_partkey AS campaign, array(concat('# Campaign ', p_name), concat('Make a ', p_name, ' clip. Keep it vertical, ', p_size, ' seconds at most.'),
  CASE WHEN p_partkey % 3 <> 0 THEN concat('Tag @', lower(replace(p_brand, '#', '')), ' and use #', replace(p_brand, '#', ''), ' plus #ad. Link in bio is required!') END,
  CASE WHEN p_partkey % 4 <> 0 THEN concat('Submit within ', p_size, CASE p_partkey % 3 WHEN 0 THEN ' min' WHEN 1 THEN ' hours' ELSE ' days' END, ' of posting. The deadline is day ', p_size) END,
  CASE WHEN p_partkey % 5 <> 0 THEN concat('Minimum ', p_size * 100, ' views to qualify; at least ', p_size, ' seconds. Views over ', p_size, 'k views pay double') END,
  CASE WHEN p_partkey % 2 = 0 THEN concat('Do not use: casino, free ', lower(p_type), ' or gambling') END, CASE WHEN p_partkey % 6 <> 0 THEN concat('Payout $', CAST(floor(p_retailprice) AS BIGINT), ' per 1k views') END,
  CASE WHEN p_partkey % 7 = 0 THEN 'The watermark is in the folder' END) AS a FROM part) t LATERAL VIEW posexplode(a) e AS p, c WHERE c IS NOT NULL
-- view: v_brief_lines duckdb
SELECT campaign, CAST(0 AS BIGINT) AS doc_id, CAST(p AS BIGINT) AS line_no, c AS text FROM (SELECT campaign, unnest(a) AS c, generate_subscripts(a, 1) - 1 AS p FROM (SELECT p_partkey AS campaign, [concat('# Campaign ', p_name), concat('Make a ', p_name, ' clip. Keep it vertical, ', p_size, ' seconds at most.'),
  CASE WHEN p_partkey % 3 <> 0 THEN concat('Tag @', lower(replace(p_brand, '#', '')), ' and use #', replace(p_brand, '#', ''), ' plus #ad. Link in bio is required!') END,
  CASE WHEN p_partkey % 4 <> 0 THEN concat('Submit within ', p_size, CASE p_partkey % 3 WHEN 0 THEN ' min' WHEN 1 THEN ' hours' ELSE ' days' END, ' of posting. The deadline is day ', p_size) END,
  CASE WHEN p_partkey % 5 <> 0 THEN concat('Minimum ', p_size * 100, ' views to qualify; at least ', p_size, ' seconds. Views over ', p_size, 'k views pay double') END,
  CASE WHEN p_partkey % 2 = 0 THEN concat('Do not use: casino, free ', lower(p_type), ' or gambling') END, CASE WHEN p_partkey % 6 <> 0 THEN concat('Payout $', CAST(floor(p_retailprice) AS BIGINT), ' per 1k views') END,
  CASE WHEN p_partkey % 7 = 0 THEN 'The watermark is in the folder' END] AS a FROM part) t) u WHERE c IS NOT NULL
-- view: v_brief_rules both
SELECT p_partkey AS campaign, 'required' AS field, CAST(1 AS BIGINT) AS ord, concat('caption: say ', p_name) AS value FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'required', CAST(2 AS BIGINT), 'logo: keep the logo in view' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'required', CAST(3 AS BIGINT), concat('Restriction: no ', CASE WHEN p_size % 2 = 0 THEN 'end screen' ELSE 'gore' END) FROM part WHERE p_partkey % 3 <> 1
UNION ALL SELECT p_partkey, 'required', CAST(4 AS BIGINT), concat('content_source: only  from day ', CAST(p_size AS VARCHAR(10))) FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, 'required', CAST(5 AS BIGINT), 'quality: sharp' FROM part WHERE p_partkey % 8 = 2
UNION ALL SELECT p_partkey, 'watermark_required', CAST(0 AS BIGINT), CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'False' END FROM part WHERE p_size % 3 <> 2
UNION ALL SELECT p_partkey, 'resolution', CAST(0 AS BIGINT), '1080x1920' FROM part WHERE p_partkey % 5 = 3
UNION ALL SELECT p_partkey, 'aspect_ratio', CAST(0 AS BIGINT), '9:16' FROM part WHERE p_partkey % 5 = 3
UNION ALL SELECT p_partkey, 'style_guidance', CAST(0 AS BIGINT), 'calm' FROM part WHERE p_partkey % 9 = 1
UNION ALL SELECT p_partkey, 'ambiguities', CAST(p_size AS BIGINT), concat('is day ', CAST(p_size AS VARCHAR(10)), ' open?') FROM part WHERE p_partkey % 10 = 7
-- view: v_board both
SELECT p_partkey AS id, p_name AS name, p_retailprice / 2000 AS composite, p_size % 6 AS core_known, p_size AS pre_score,
       CASE p_partkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'refreshed' ELSE 'scraped' END AS status,
       p_partkey % 11 = 0 AS disqualified, p_partkey % 13 = 0 AS rules_unreadable, p_partkey % 19 = 0 AS excluded_prohibited,
       CASE p_partkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'modal' WHEN 2 THEN 'gdoc' WHEN 3 THEN 'notion' WHEN 4 THEN 'unreadable' END AS rules_source,
       CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN concat('clips of the ', p_name, ' live stream') END AS rules_text, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS n_rule_links,
       lower(p_type) AS category, CASE p_size % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'promo' END AS second_category,
       upper(p_brand) AS lane, CASE WHEN p_size % 4 = 1 THEN 'brand#7 ' END AS second_lane, p_size % 4 AS n_links, p_partkey % 17 = 0 AS is_done,
       CASE WHEN p_partkey % 7 = 0 THEN 'de' ELSE 'en' END AS lang, CASE WHEN p_partkey % 14 = 0 THEN 'low' ELSE 'high' END AS lang_conf,
       CASE WHEN p_partkey % 23 <> 0 THEN concat('2024-01-', lpad(CAST(1 + (p_partkey + p_size) % 28 AS VARCHAR(2)), 2, '0'), 'T06:00:00Z') END AS generated_at
FROM part
-- view: v_resources both
SELECT l_orderkey AS campaign,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord,
       concat('F', CAST(l_partkey AS VARCHAR(20)),
              CASE l_partkey % 6 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mov' WHEN 2 THEN '.png' WHEN 3 THEN '.pdf' WHEN 4 THEN '.bin' ELSE '.mkv' END) AS path,
       l_suppkey AS source, l_suppkey * 1000 + l_partkey AS size, l_quantity * 60 AS duration_sec, l_returnflag = 'A' AS safe_margin
FROM lineitem
-- view: v_urls both
SELECT page_id, concat(CASE page_id % 11 WHEN 0 THEN 'https://drive.google.com/drive/folders/' WHEN 1 THEN 'https://www.youtube.com/watch?v=' WHEN 2 THEN 'https://www.youtube.com/@' WHEN 3 THEN 'https://docs.google.com/document/d/'
                                        WHEN 4 THEN 'https://site.example.com/rules/' WHEN 5 THEN 'https://kick.com/' WHEN 6 THEN 'files/brief' WHEN 7 THEN 'https://site.example.com/a?rules=' WHEN 8 THEN 'https://drive.google.com/file/d/'
                                        WHEN 9 THEN 'https://whop.com/discover/rules/' ELSE 'https://site.example.com/page' END,
       CAST(page_id AS VARCHAR(20)), CASE page_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '' ELSE '.pdf' END) AS url, CASE page_id % 5 WHEN 0 THEN 'Must read' ELSE 'more' END AS label
FROM pages
UNION ALL SELECT page_id, url, '' AS label FROM pages
-- view: v_links spark
SELECT DISTINCT page_id AS src, h AS dst FROM pages LATERAL VIEW explode(regexp_extract_all(html, '<a href="(/[^"]+)"', 1)) x AS h
-- view: v_links duckdb
SELECT DISTINCT page_id AS src, h AS dst FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]+)"', 1)) AS h FROM pages) t
-- view: v_errors both
SELECT event_id, user_id,
       CASE event_id % 12 WHEN 0 THEN 'Error code: 429 rate limit tokens per day (TPD), try again in 5m30s'
                         WHEN 1 THEN 'rate_limit tokens per minute (TPM) retry after 12'
                         WHEN 2 THEN '404 model not found' WHEN 3 THEN 'status code: 403 permission'
                         WHEN 4 THEN 'note [{"id":"m1","score":71},{"id":"m2","score":8}] end' WHEN 5 THEN 'connection reset'
                         WHEN 6 THEN concat('ResourceExhausted: quota exceeded, retry_delay { seconds: ', CAST(event_id % 200 AS VARCHAR(20)), ' }')
                         WHEN 7 THEN concat('Quota: please try again in 1h', CAST(event_id % 60 AS VARCHAR(20)), 'm2.5s')
                         WHEN 8 THEN concat('status code: ', CAST(400 + event_id % 200 AS VARCHAR(20)), ' have had many accesses')
                         WHEN 9 THEN concat('```json', chr(10), '["- First line", "2. second, with a comma", "", 7]', chr(10), '```')
                         WHEN 10 THEN concat('Here are some:', chr(10), '1. "Wait for it",', chr(10), '* no way', chr(10), '- x', chr(10), chr(10), 'Sure thing', chr(10), '"take ', CAST(event_id AS VARCHAR(20)), '" ')
                         ELSE 'see [1] then [{"id":"m3","score":"high"}] language gate: no usable footage' END AS msg
FROM events WHERE event_type = 'error'
-- view: v_attempts both
SELECT o_custkey AS walk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt,
       CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 9 END AS clips, o_orderstatus AS status,
       CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 7 WHEN 0 THEN 'language gate: mostly de' WHEN 1 THEN 'No footage in the folder' WHEN 2 THEN 'best is under the dead-floor' WHEN 3 THEN 'zero usable sources'
                                             WHEN 4 THEN 'no candidate moments' WHEN 5 THEN 'HTTP Error 429: Too Many Requests' ELSE 'it broke off' END END AS msg
FROM orders
-- view: v_detections both
SELECT user_id AS clip_id, event_id AS frame, event_id % 7 AS bucket,
       CASE WHEN event_id % 7 < 4 THEN 1 WHEN event_id % 7 = 4 THEN 0 ELSE 2 END AS n_subjects, value AS cx
FROM events
-- view: v_formats both
SELECT l_orderkey AS item, concat(CAST(l_partkey AS VARCHAR(20)), '_', CAST(l_suppkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20))) AS format_id,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE (l_linenumber % 4) * 540 END AS height,
       l_suppkey % 2 = 0 OR l_linenumber % 4 = 0 AS has_audio, l_quantity AS tbr, l_extendedprice AS size
FROM lineitem
-- view: v_boxes both
SELECT user_id AS clip_id, event_id - event_id % 3 AS frame, event_id AS box_id,
       CASE WHEN event_id % 5 < 3 THEN 'person' ELSE 'face' END AS class,
       value AS cx, value / 2 AS cy, CAST(10 + event_id % 40 AS DOUBLE) AS w, CAST(10 + event_id % 70 AS DOUBLE) AS h
FROM events
