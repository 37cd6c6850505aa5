-- The nine insurance tables over the sample views, then the per-document text signals.
m_base AS (
  SELECT DATE '2024-01-31' AS as_of, greatest(1, (SELECT count(*) FROM customer) // 10) AS n_act
),
m_customer AS (
  SELECT 'CUST-' || lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INTEGER, '0') AS customer_id,
         c_custkey AS num, c_nationkey,
         'Customer' AS first_name, right(c_name, 9) AS last_name,
         ['Male','Female','Other'][c_custkey % 3 + 1] AS gender,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Premium' WHEN 'HOUSEHOLD' THEN 'Enterprise'
              WHEN 'MACHINERY' THEN 'Basic' ELSE 'Standard' END AS segment,
         r_name AS region, n_name AS state,
         (c_custkey % 240 + 1)::INTEGER AS tenure_months, c_acctbal AS lifetime_value,
         DATE '2024-01-31' - (c_custkey % 2000 + 1)::INTEGER AS created_on
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
m_policy AS (
  SELECT 'POL-' || lpad(o_orderkey::VARCHAR, greatest(7, length(o_orderkey::VARCHAR))::INTEGER, '0') AS policy_id,
         'CUST-' || lpad(o_custkey::VARCHAR, greatest(6, length(o_custkey::VARCHAR))::INTEGER, '0') AS customer_id,
         ['Auto','Home','Life','Health','Umbrella','Renters','Travel','Pet'][(o_orderkey // 4) % 8 + 1] AS policy_type,
         o_totalprice / 100 AS premium_amount,
         DATE '2024-01-31' - (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 731)::INTEGER AS start_date,
         DATE '2024-01-31' + (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 336 + 30)::INTEGER AS end_date,
         CASE WHEN o_orderstatus IN ('O','P') THEN 'Active' WHEN o_orderpriority LIKE '1%' THEN 'Cancelled'
              WHEN o_orderpriority LIKE '5%' THEN 'Pending' ELSE 'Expired' END AS status
  FROM orders
),
m_line AS (
  SELECT l.*, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS line_key,
         'CUST-' || lpad(o_custkey::VARCHAR, greatest(6, length(o_custkey::VARCHAR))::INTEGER, '0') AS customer_id,
         date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS age
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
),
m_claim AS (
  SELECT 'CLM-' || line_key AS claim_id, customer_id,
         ['Collision','Theft','Water Damage','Fire','Medical','Liability','Windstorm','Vandalism'][l_suppkey % 8 + 1] AS claim_type,
         l_extendedprice AS claim_amount,
         CASE WHEN l_partkey % 20 = 0 THEN 'Open' WHEN l_partkey % 20 = 1 THEN 'Under Review'
              WHEN l_partkey % 20 <= 6 THEN 'Approved' WHEN l_partkey % 20 <= 9 THEN 'Denied'
              WHEN l_partkey % 20 <= 15 THEN 'Settled' ELSE 'Closed' END AS status,
         DATE '2024-01-31' - (age % 365 + 1)::INTEGER AS filed_date,
         CASE WHEN l_partkey % 20 > 1 THEN (l_suppkey % 58 + 3)::INTEGER END AS resolution_days
  FROM m_line WHERE l_returnflag = 'R'
),
m_payment AS (
  SELECT 'PAY-' || line_key AS payment_id, customer_id, l_extendedprice AS amount,
         CASE WHEN (l_partkey + l_suppkey) % 20 < 2 THEN 'Failed' WHEN (l_partkey + l_suppkey) % 20 = 2 THEN 'Pending'
              WHEN (l_partkey + l_suppkey) % 20 = 3 THEN 'Refunded' ELSE 'Completed' END AS status,
         ['Credit Card','Debit Card','Bank Transfer','ACH','Check','Auto-Pay'][l_suppkey % 6 + 1] AS payment_method,
         CASE WHEN (l_partkey + l_suppkey) % 20 < 2
              THEN ['Insufficient funds','Card declined','Account closed','Invalid routing number','Payment limit exceeded'][l_partkey % 5 + 1]
         END AS failure_reason,
         DATE '2024-01-31' - (age % 366)::INTEGER AS payment_date
  FROM m_line WHERE l_returnflag <> 'R'
),
m_interaction AS (
  SELECT 'INT-' || lpad(event_id::VARCHAR, greatest(7, length(event_id::VARCHAR))::INTEGER, '0') AS interaction_id,
         'CUST-' || lpad(user_id::VARCHAR, greatest(6, length(user_id::VARCHAR))::INTEGER, '0') AS customer_id,
         CASE event_type WHEN 'view' THEN 'Web Portal' WHEN 'click' THEN 'Mobile App' WHEN 'error' THEN 'Phone'
              WHEN 'signup' THEN 'Chat' ELSE 'Email' END AS channel,
         ['Inbound','Outbound'][event_id % 2 + 1] AS direction,
         ts - to_days((user_id % 8 * 30)::INTEGER) AS interaction_date,
         ['Billing Inquiry','Claim Status','Policy Change','Cancellation Request','New Quote','Payment Issue',
          'Coverage Question','Complaint','Renewal','General Inquiry'][event_id % 10 + 1] AS topic,
         ['Resolved','Escalated','Follow-up Required','Transferred','Closed','Pending'][event_id % 6 + 1] AS disposition
  FROM events
),
m_doc AS (
  SELECT doc_id, text, source, lpad(doc_id::VARCHAR, greatest(7, length(doc_id::VARCHAR))::INTEGER, '0') AS num,
         'CUST-' || lpad((doc_id % n_act)::VARCHAR, greatest(6, length((doc_id % n_act)::VARCHAR))::INTEGER, '0') AS customer_id,
         DATE '2024-01-31' - (doc_id * 7 % 180)::INTEGER AS written_on,
         CASE WHEN source IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9') THEN 'TRANSCRIPT'
              WHEN source IN ('src10','src11','src12','src13','src14') THEN 'EMAIL' ELSE 'NOTE' END AS kind
  FROM documents, m_base
),
m_survey AS (
  SELECT 'SRV-' || num AS survey_id, customer_id,
         ['NPS','CSAT','Post-Claim','Post-Call','Annual'][doc_id % 5 + 1] AS survey_type,
         nps AS nps_score, least(5, 1 + nps // 2) AS csat_score, text AS comments, written_on
  FROM (SELECT d.*, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 7 ELSE 9 END
                         WHEN toxic = 1 THEN 2 ELSE 5 END + (d.doc_id % 2)::INTEGER AS nps
        FROM labels JOIN m_doc d USING (doc_id))
),
m_prior AS (
  SELECT 'NBA-OLD-' || customer_id AS action_id, customer_id,
         ['RETENTION_OFFER','CLAIMS_ESCALATION','COMPETITOR_RETENTION_CAMPAIGN','CROSS_SELL','PAYMENT_ASSISTANCE'][c_nationkey % 5 + 1] AS action_type,
         0.75::DOUBLE AS confidence, 'Carried over from an earlier run' AS rationale, 2 AS priority,
         ['APPROVED','REJECTED','COMPLETED','PENDING','SUPPRESSED'][num % 5 + 1] AS status,
         num % 5 = 4 AS suppressed,
         CASE WHEN num % 5 = 4 THEN 'Suppressed: earlier run' END AS suppression_reason,
         DATE '2024-01-01' AS created_on,
         DATE '2024-01-31' + (num % 21 - 10)::INTEGER AS expires_on
  FROM m_customer
),
t_split AS (
  SELECT *, string_split_regex(lower(text), '[^a-z0-9]+') AS w,
         string_split_regex(lower(CASE WHEN kind = 'EMAIL' THEN source || chr(10) || text ELSE text END), '[^a-z0-9]+') AS iw
  FROM m_doc WHERE kind <> 'NOTE'
),
t_count AS (
  SELECT * EXCLUDE (w, iw),
         len(list_filter(w, lambda t: t IN ('best','reat','reing','enst','rely'))) AS pos,
         len(list_filter(w, lambda t: t IN ('worthless','stupid','idiot','annt','onor','aning'))) AS neg,
         list_sort(list_distinct(list_filter(w, lambda t: t IN ('license','onwh','ansh')))) AS competitors,
         list_sort(list_distinct(list_filter(w, lambda t: t IN ('inth','reor','onsh')))) AS products,
         list_sort(list_distinct(list_filter(w, lambda t: t IN ('anes','onea')))) AS people,
         list_has_any(iw, ['worthless','inan','annd']) AS cancellation_intent,
         list_has_any(iw, ['innd','enon']) AS payment_issue,
         list_has_any(iw, ['ener','reon']) AS product_request,
         list_has_any(iw, ['stupid','idiot','onor']) AS complaint,
         list_has_any(iw, ['ones','anth']) AS price_sensitivity,
         list_has_any(iw, ['license','onwh','ansh']) AS competitor_comparison
  FROM t_split
),
t_score AS (
  SELECT *, coalesce(round((pos - neg)::DOUBLE / nullif(pos + neg, 0), 6), 0.0) AS score,
         CASE kind WHEN 'TRANSCRIPT' THEN 'TRN-' ELSE 'EML-' END || num AS source_id
  FROM t_count
),
t_signal AS MATERIALIZED (
  SELECT *,
         CASE WHEN score >= 0.3 THEN 'POSITIVE' WHEN score <= -0.3 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
         CASE WHEN cancellation_intent THEN 'CHURN' WHEN complaint THEN 'CLAIM_FRICTION'
              WHEN price_sensitivity THEN 'PRICE_SENSITIVITY' WHEN payment_issue THEN 'PAYMENT_ISSUE'
              WHEN product_request THEN 'CROSS_SELL_OPPORTUNITY' WHEN score >= 0.3 THEN 'POSITIVE_ENGAGEMENT'
              ELSE 'GENERAL_INQUIRY' END AS klass,
         CASE kind WHEN 'TRANSCRIPT' THEN 'ENR-INT-' ELSE 'ENR-INT-E-' END || source_id AS intents_row,
         kind = 'TRANSCRIPT' AS is_call
  FROM t_score
),
s_customer AS (
  SELECT customer_id, count(*) AS sentiment_count,
         round(sum(round(score * 1000000)::BIGINT)::DOUBLE / 1000000 / count(*), 12) AS avg_sentiment
  FROM t_signal GROUP BY customer_id
),
-- enrichment rows: one per document and enricher
e_row AS (
  SELECT CASE WHEN is_call THEN 'ENR-T-' ELSE 'ENR-E-' END || source_id AS enrichment_id, customer_id, kind AS source_table,
         source_id, score AS sentiment_score, label AS sentiment_label, NULL::VARCHAR AS competitors,
         NULL::BOOLEAN AS cancellation_intent, NULL::VARCHAR AS classification, NULL::VARCHAR AS summary
  FROM t_signal
  UNION ALL
  SELECT 'ENR-ENT-' || source_id, customer_id, kind, source_id, NULL, NULL, array_to_string(competitors, ','), NULL, NULL, NULL
  FROM t_signal WHERE is_call
  UNION ALL
  SELECT intents_row, customer_id, kind, source_id, NULL, NULL, NULL, cancellation_intent, NULL, NULL FROM t_signal
  UNION ALL
  SELECT 'ENR-CLS-' || source_id, customer_id, kind, source_id, NULL, NULL, NULL, NULL, klass, NULL
  FROM t_signal WHERE is_call
),
-- digest lines, summary
d_line AS (
  SELECT customer_id, kind, written_on,
         CASE kind WHEN 'TRANSCRIPT' THEN 'TRN-' WHEN 'EMAIL' THEN 'EML-' ELSE 'NTE-' END || num AS doc_key,
         '- [' || CASE kind WHEN 'TRANSCRIPT' THEN 'Transcript' WHEN 'EMAIL' THEN 'Email' ELSE 'Note' END || '] '
         || left(CASE WHEN kind = 'EMAIL' THEN source || ': ' || text ELSE text END, 200) AS line
  FROM m_doc
),
d_summary AS (
  SELECT c.customer_id,
         CASE WHEN x.customer_id IS NULL THEN 'No recent interactions recorded.' ELSE
           x.calls || ' transcripts, ' || x.mails || ' e-mails, ' || x.notes || ' notes. Average sentiment: '
           || coalesce(round((s.avg_sentiment * 100)::DECIMAL(18,8), 1)::DECIMAL(18,1)::VARCHAR, 'none')
           || '. Intents: ' || coalesce(nullif(array_to_string(i.flags, ', '), ''), 'none')
           || '. Latest: ' || coalesce(x.latest, 'none') END AS summary
  FROM m_customer c
  LEFT JOIN (SELECT customer_id, count(*) FILTER (kind = 'TRANSCRIPT') AS calls, count(*) FILTER (kind = 'EMAIL') AS mails,
                    count(*) FILTER (kind = 'NOTE') AS notes, last(line ORDER BY written_on, doc_key) AS latest
             FROM d_line GROUP BY 1) x USING (customer_id)
  LEFT JOIN s_customer s USING (customer_id)
  LEFT JOIN (SELECT customer_id, list_filter([
               CASE WHEN bool_or(cancellation_intent) THEN 'cancellation_intent ' || count(*) FILTER (cancellation_intent) END,
               CASE WHEN bool_or(payment_issue) THEN 'payment_issue ' || count(*) FILTER (payment_issue) END,
               CASE WHEN bool_or(product_request) THEN 'product_request ' || count(*) FILTER (product_request) END,
               CASE WHEN bool_or(complaint) THEN 'complaint ' || count(*) FILTER (complaint) END,
               CASE WHEN bool_or(price_sensitivity) THEN 'price_sensitivity ' || count(*) FILTER (price_sensitivity) END,
               CASE WHEN bool_or(competitor_comparison) THEN 'competitor_comparison ' || count(*) FILTER (competitor_comparison) END
             ], lambda f: f IS NOT NULL) AS flags FROM t_signal GROUP BY 1) i USING (customer_id)
),
-- events
v_event AS (
  SELECT 'EVT-POL-' || policy_id AS event_id, customer_id,
         coalesce(MAP {'Active': 'POLICY_ACTIVE', 'Cancelled': 'POLICY_CANCELLED', 'Expired': 'POLICY_EXPIRED'}[status], 'POLICY_CREATED') AS event_type,
         start_date::TIMESTAMP AS event_at, 'POLICY' AS source_table, policy_id AS source_id
  FROM m_policy
  UNION ALL
  SELECT 'EVT-CLM-' || claim_id, customer_id,
         coalesce(MAP {'Open': 'CLAIM_FILED', 'Under Review': 'CLAIM_REVIEW', 'Approved': 'CLAIM_APPROVED',
                       'Denied': 'CLAIM_DENIED', 'Settled': 'CLAIM_SETTLED'}[status], 'CLAIM_CLOSED'),
         filed_date::TIMESTAMP, 'CLAIM', claim_id
  FROM m_claim
  UNION ALL
  SELECT 'EVT-PAY-' || payment_id, customer_id,
         coalesce(MAP {'Completed': 'PAYMENT_SUCCESS', 'Failed': 'PAYMENT_FAILED', 'Refunded': 'PAYMENT_REFUNDED'}[status], 'PAYMENT_PENDING'),
         payment_date::TIMESTAMP, 'PAYMENT', payment_id
  FROM m_payment
  UNION ALL
  SELECT 'EVT-INT-' || interaction_id, customer_id, 'INTERACTION_' || upper(channel), interaction_date, 'INTERACTION', interaction_id
  FROM m_interaction
  UNION ALL
  SELECT 'EVT-SRV-' || survey_id, customer_id, 'SURVEY_SUBMITTED', written_on::TIMESTAMP, 'SURVEY', survey_id
  FROM m_survey
),
-- moments: all qualifying pairs first, then one per customer
p_soon AS (
  SELECT customer_id, date_diff('day', DATE '2024-01-31', end_date) AS renewal_days FROM m_policy WHERE status = 'Active'
),
o_m1_all AS (
  SELECT t.customer_id, renewal_days, 'ENR-ENT-' || source_id AS row_id, competitors
  FROM t_signal t JOIN p_soon p ON t.customer_id = p.customer_id
  WHERE is_call AND len(competitors) > 0 AND renewal_days > 0 AND renewal_days <= 45
),
o_m1 AS (
  SELECT * FROM o_m1_all QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY renewal_days, row_id) = 1
),
o_m2_all AS (
  SELECT customer_id, score, intents_row AS row_id FROM t_signal
  WHERE score < -0.3 AND cancellation_intent AND NOT EXISTS (SELECT 1 FROM o_m1 WHERE o_m1.customer_id = t_signal.customer_id)
),
o_m2 AS (
  SELECT * FROM o_m2_all QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY score, row_id) = 1
),
o_m3 AS (
  SELECT c.customer_id, claim_id, claim_type, claim_amount, status, date_diff('day', filed_date, DATE '2024-01-31') AS days_open, avg_sentiment
  FROM m_claim c JOIN s_customer s ON s.customer_id = c.customer_id
  WHERE status IN ('Open', 'Under Review') AND date_diff('day', filed_date, DATE '2024-01-31') > 14 AND avg_sentiment < -0.2
),
o_m4 AS (
  SELECT customer_id, min(intents_row) AS row_id FROM t_signal WHERE price_sensitivity GROUP BY 1
),
o_moment AS (
  SELECT 'MOM-CHR-' || customer_id || '-20240131000000' AS moment_id, customer_id, 'CHURN' AS moment_type, 0.85::DOUBLE AS confidence,
         row_id AS source_event_id, DATE '2024-01-31' + 30 AS expires_on, renewal_days AS detail FROM o_m1
  UNION ALL
  SELECT 'MOM-CHR2-' || customer_id || '-20240131000000', customer_id, 'CHURN', 0.9, row_id, DATE '2024-01-31' + 14, score FROM o_m2
  UNION ALL
  SELECT 'MOM-CF-' || customer_id || '-' || claim_id, customer_id, 'CLAIM_FRICTION', 0.8, 'EVT-CLM-' || claim_id, DATE '2024-01-31' + 7, days_open FROM o_m3
  UNION ALL
  SELECT 'MOM-PS-' || customer_id || '-20240131000000', customer_id, 'PRICE_SENSITIVITY', 0.75, row_id, DATE '2024-01-31' + 30, NULL FROM o_m4
),
-- health: one scalar fact row per customer
h_claims AS (
  SELECT customer_id, count(*) AS total_claims, count(*) FILTER (status IN ('Open', 'Under Review')) AS open_claims,
         count(*) FILTER (status = 'Denied') AS denied_claims,
         sum(resolution_days)::DOUBLE / nullif(count(resolution_days), 0) AS avg_resolution
  FROM m_claim GROUP BY 1
),
h_payments AS (
  SELECT customer_id, count(*) AS total_payments, count(*) FILTER (status = 'Failed') AS failed_payments,
         (count(*) FILTER (status = 'Failed'))::DOUBLE / count(*) AS failure_rate
  FROM m_payment GROUP BY 1
),
h_engagement AS (
  SELECT customer_id, count(*) AS interaction_count, max(interaction_date) AS last_interaction,
         date_diff('day', max(interaction_date)::DATE, DATE '2024-01-31') AS days_since_last
  FROM m_interaction GROUP BY 1
),
h_fact AS (
  SELECT customer_id, avg_sentiment, open_claims, denied_claims, avg_resolution, failure_rate, days_since_last,
         EXISTS (SELECT 1 FROM o_m1 WHERE o_m1.customer_id = m_customer.customer_id)
         OR EXISTS (SELECT 1 FROM o_m2 WHERE o_m2.customer_id = m_customer.customer_id) AS has_churn
  FROM m_customer
  LEFT JOIN s_customer USING (customer_id) LEFT JOIN h_claims USING (customer_id)
  LEFT JOIN h_payments USING (customer_id) LEFT JOIN h_engagement USING (customer_id)
),
h_part AS (
  SELECT *,
         CASE WHEN avg_sentiment IS NULL THEN 50.0::DOUBLE ELSE greatest(0::DOUBLE, least(100::DOUBLE, avg_sentiment * 50 + 50)) END AS s,
         CASE WHEN avg_resolution IS NULL THEN 80.0::DOUBLE
              ELSE greatest(0::DOUBLE, least(100::DOUBLE, 100::DOUBLE - (open_claims * 15 + denied_claims * 10 + least(avg_resolution, 60::DOUBLE) * 0.5::DOUBLE))) END AS c,
         CASE WHEN failure_rate IS NULL THEN 90.0::DOUBLE ELSE greatest(0::DOUBLE, least(100::DOUBLE, 100::DOUBLE - failure_rate * 200)) END AS p,
         CASE WHEN days_since_last <= 7 THEN 95.0::DOUBLE WHEN days_since_last <= 30 THEN 80 WHEN days_since_last <= 90 THEN 60
              WHEN days_since_last <= 180 THEN 40 ELSE 20 END AS e,
         least(100, CASE WHEN has_churn THEN 40 ELSE 0 END + CASE WHEN avg_sentiment < -0.3 THEN 20 ELSE 0 END
           + CASE WHEN failure_rate > 0.2::DOUBLE THEN 15 ELSE 0 END + CASE WHEN open_claims > 2 THEN 15 ELSE 0 END
           + CASE WHEN days_since_last > 90 THEN 10 ELSE 0 END) AS churn_pct
  FROM h_fact
),
o_health AS MATERIALIZED (
  SELECT customer_id,
         round((s * 0.25::DOUBLE + c * 0.2::DOUBLE + p * 0.2::DOUBLE + e * 0.15::DOUBLE
                + (1::DOUBLE - churn_pct::DOUBLE / 100) * 100 * 0.2::DOUBLE)::DECIMAL(28,8), 2)::DOUBLE AS health_score,
         churn_pct::DOUBLE / 100 AS churn_risk,
         round(s::DECIMAL(28,8), 2)::DOUBLE AS sentiment_score, round(c::DECIMAL(28,8), 2)::DOUBLE AS claims_score,
         round(p::DECIMAL(28,8), 2)::DOUBLE AS payment_score, round(e::DECIMAL(28,8), 2)::DOUBLE AS engagement_score,
         CASE WHEN churn_pct >= 70 THEN 'CRITICAL' WHEN churn_pct >= 40 THEN 'AT_RISK' WHEN churn_pct >= 20 THEN 'MONITOR' ELSE 'HEALTHY' END AS risk_level
  FROM h_part
),
-- actions
n_kept AS (SELECT * FROM m_prior WHERE status NOT IN ('PENDING', 'SUPPRESSED')),
n_held AS (SELECT DISTINCT customer_id, action_type FROM n_kept WHERE status IN ('PENDING', 'APPROVED')),
n_ret AS (
  SELECT h.customer_id, churn_risk, sentiment_score, min(renewal_days) AS renewal_days
  FROM o_health h JOIN p_soon p ON p.customer_id = h.customer_id
  WHERE churn_risk >= 0.4::DOUBLE AND sentiment_score < 50 AND renewal_days BETWEEN 1 AND 60
    AND (h.customer_id, 'RETENTION_OFFER') NOT IN (SELECT (customer_id, action_type) FROM n_held)
  GROUP BY ALL
),
n_clm AS (
  SELECT c.customer_id, claim_id, claim_amount, date_diff('day', filed_date, DATE '2024-01-31') AS days_open, sentiment_score
  FROM m_claim c JOIN o_health h ON h.customer_id = c.customer_id
  WHERE status IN ('Open', 'Under Review') AND date_diff('day', filed_date, DATE '2024-01-31') > 14 AND sentiment_score < 50
    AND (c.customer_id, 'CLAIMS_ESCALATION') NOT IN (SELECT (customer_id, action_type) FROM n_held)
),
n_crc AS (
  SELECT * FROM o_m1
  WHERE (customer_id, 'COMPETITOR_RETENTION_CAMPAIGN') NOT IN (SELECT (customer_id, action_type) FROM n_held)
),
n_xsl AS (
  SELECT c.customer_id, segment, health_score, sentiment_score,
         CASE WHEN sentiment_score < 40 THEN 'Suppressed: negative sentiment detected'
              WHEN risk_level IN ('CRITICAL', 'AT_RISK') THEN 'Suppressed: customer at churn risk' END AS reason
  FROM m_customer c JOIN o_health h ON h.customer_id = c.customer_id
  WHERE segment IN ('Premium', 'Enterprise') AND health_score >= 60
    AND (c.customer_id, 'CROSS_SELL') NOT IN (SELECT (customer_id, action_type) FROM n_held)
),
n_pay AS (
  SELECT customer_id, count(*) FILTER (status = 'Failed') AS failed, count(*) AS total
  FROM m_payment WHERE payment_date >= DATE '2023-10-31'
    AND (customer_id, 'PAYMENT_ASSISTANCE') NOT IN (SELECT (customer_id, action_type) FROM n_held)
  GROUP BY 1 HAVING count(*) FILTER (status = 'Failed') >= 2
),
n_new AS (
  SELECT 'NBA-RET-' || customer_id || '-20240131000000' AS action_id, customer_id, 'RETENTION_OFFER' AS action_type,
         round(least(0.95, 0.5 + churn_risk * 0.5), 6)::DOUBLE AS confidence,
         'High churn risk (' || round((churn_risk * 100)::DECIMAL(18,8), 1)::DECIMAL(18,1) || '%) with negative sentiment ('
         || round(sentiment_score::DECIMAL(18,8), 1)::DECIMAL(18,1)
         || ') and policy renewal within 60 days. Recommend proactive retention outreach with discount offer.' AS rationale,
         1 AS priority, NULL::VARCHAR AS suppression_reason, DATE '2024-01-31' + 14 AS expires_on
  FROM n_ret
  UNION ALL
  SELECT 'NBA-CLM-' || customer_id || '-' || claim_id, customer_id, 'CLAIMS_ESCALATION',
         round(least(0.90, 0.6 + (days_open - 14) * 0.01), 6)::DOUBLE,
         'Open claim (' || claim_id || ') pending for ' || days_open
         || ' days with negative customer sentiment. Escalate to claims manager for expedited resolution.',
         2, NULL, DATE '2024-01-31' + 7
  FROM n_clm
  UNION ALL
  SELECT 'NBA-CRC-' || customer_id || '-20240131000000', customer_id, 'COMPETITOR_RETENTION_CAMPAIGN', 0.8,
         'Customer mentioned competitor(s) in recent interaction with policy renewal within 45 days. Initiate targeted retention campaign with competitive comparison and loyalty benefits.',
         2, NULL, DATE '2024-01-31' + 10
  FROM n_crc
  UNION ALL
  SELECT 'NBA-XSL-' || customer_id || '-20240131000000', customer_id, 'CROSS_SELL', 0.7,
         'Premium segment customer with positive sentiment and good engagement. Eligible for cross-sell of additional coverage products.',
         3, reason, DATE '2024-01-31' + 30
  FROM n_xsl
  UNION ALL
  SELECT 'NBA-PAY-' || customer_id || '-20240131000000', customer_id, 'PAYMENT_ASSISTANCE',
         round(least(0.90, 0.5 + failed * 0.15), 6)::DOUBLE,
         'Customer has ' || failed || ' failed payments in recent period. Proactive outreach to resolve payment method issues and prevent policy lapse.',
         2, NULL, DATE '2024-01-31' + 7
  FROM n_pay
),
o_action AS MATERIALIZED (
  SELECT action_id, customer_id, action_type, confidence, rationale, priority, status, suppressed, suppression_reason,
         created_on, expires_on FROM n_kept
  UNION ALL
  SELECT action_id, customer_id, action_type, confidence, rationale, priority,
         CASE WHEN suppression_reason IS NULL THEN 'PENDING' ELSE 'SUPPRESSED' END, suppression_reason IS NOT NULL,
         suppression_reason, DATE '2024-01-31', expires_on FROM n_new
),
-- workflow
w_decision AS (
  SELECT action_id, ['APPROVED','REJECTED','MAYBE'][split_part(customer_id, '-', 2)::BIGINT % 3 + 1] AS decision,
         'user-' || split_part(customer_id, '-', 2)::BIGINT % 4 AS decided_by
  FROM o_action
),
w_log AS (
  SELECT 'LOG-' || action_id || '-20240131000000' AS log_id, action_id, customer_id, action_type, decision, decided_by,
         split_part(customer_id, '-', 2)::BIGINT AS num
  FROM o_action JOIN w_decision USING (action_id)
  WHERE status = 'PENDING' AND decision IN ('APPROVED', 'REJECTED')
),
w_outcome AS (
  SELECT action_id, CASE WHEN num % 2 = 0 THEN 'SUCCESSFUL' ELSE 'FAILED' END AS outcome, 'note for ' || customer_id AS notes
  FROM w_log WHERE num % 5 <> 0
),
o_log AS (
  SELECT l.* EXCLUDE (num), CASE WHEN decision = 'APPROVED' THEN outcome END AS outcome,
         CASE WHEN decision = 'APPROVED' THEN notes END AS notes
  FROM w_log l LEFT JOIN w_outcome o USING (action_id)
),
-- evidence
x_doc AS (
  SELECT 'TRN-' || source_id AS doc_id, customer_id, 'TRANSCRIPT' AS source_type, text AS content, label AS sentiment, klass AS moment_type, written_on
  FROM t_signal WHERE is_call
  UNION ALL
  SELECT 'EML-' || source_id, customer_id, 'EMAIL', source || ': ' || text, label, 'UNCLASSIFIED', written_on FROM t_signal WHERE NOT is_call
  UNION ALL
  SELECT 'NTE-NTE-' || num, customer_id, 'NOTE', text, 'UNKNOWN', 'UNCLASSIFIED', written_on FROM m_doc WHERE kind = 'NOTE'
  UNION ALL
  SELECT 'SRV-' || survey_id, customer_id, 'SURVEY',
         survey_type || ' Survey (NPS: ' || nps_score || ', CSAT: ' || csat_score || '): ' || coalesce(comments, ''),
         CASE WHEN nps_score >= 9 THEN 'POSITIVE' WHEN nps_score <= 6 THEN 'NEGATIVE' ELSE 'NEUTRAL' END, 'UNCLASSIFIED', written_on
  FROM m_survey
),
x_word AS (
  SELECT x.* EXCLUDE (content), list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM x_doc x
)
