-- name: enrich_transcript_sentiment
SELECT 'ENR-T-' || source_id AS enrichment_id, customer_id, kind AS source_table, source_id, score AS sentiment_score, label AS sentiment_label
FROM t_signal WHERE is_call
-- name: enrich_email_sentiment
SELECT 'ENR-E-' || source_id AS enrichment_id, customer_id, kind AS source_table, source_id, score AS sentiment_score, label AS sentiment_label
FROM t_signal WHERE NOT is_call
-- name: enrich_entities
SELECT 'ENR-ENT-' || source_id AS enrichment_id, customer_id, kind AS source_table, source_id,
       array_to_string(competitors, ',') AS competitors, array_to_string(products, ',') AS products, array_to_string(people, ',') AS people
FROM t_signal WHERE is_call
-- name: enrich_transcript_intents
SELECT intents_row AS enrichment_id, customer_id, kind AS source_table, source_id, cancellation_intent, payment_issue,
       product_request, complaint, price_sensitivity, competitor_comparison
FROM t_signal WHERE is_call
-- name: enrich_email_intents
SELECT intents_row AS enrichment_id, customer_id, kind AS source_table, source_id, cancellation_intent, payment_issue,
       product_request, complaint, price_sensitivity, competitor_comparison
FROM t_signal WHERE NOT is_call
-- name: enrich_classification
SELECT 'ENR-CLS-' || source_id AS enrichment_id, customer_id, kind AS source_table, source_id, klass AS classification
FROM t_signal WHERE is_call
-- name: customer_text_digest
SELECT customer_id, part, count(line) AS n_lines, strftime(min(written_on), '%Y-%m-%d 00:00:00') AS oldest,
       strftime(max(written_on), '%Y-%m-%d 00:00:00') AS newest,
       string_agg(line, chr(10) ORDER BY written_on DESC, doc_key DESC) AS digest
FROM (SELECT *, (row_number() OVER (PARTITION BY customer_id ORDER BY written_on DESC, doc_key DESC) - 1) // 10000 AS part FROM d_line)
GROUP BY customer_id, part
-- name: customer_text_digest_small_parts
SELECT customer_id, part, count(line) AS n_lines, strftime(min(written_on), '%Y-%m-%d 00:00:00') AS oldest,
       strftime(max(written_on), '%Y-%m-%d 00:00:00') AS newest,
       string_agg(line, chr(10) ORDER BY written_on DESC, doc_key DESC) AS digest
FROM (SELECT *, (row_number() OVER (PARTITION BY customer_id ORDER BY written_on DESC, doc_key DESC) - 1) // 2 AS part FROM d_line)
GROUP BY customer_id, part
-- name: enrich_customer_summary
SELECT 'ENR-SUM-' || customer_id AS enrichment_id, customer_id, 'CUSTOMER' AS source_table, customer_id AS source_id, summary
FROM d_summary
-- name: unprocessed_batch
SELECT source_id AS transcript_id, customer_id FROM t_signal WHERE is_call AND len(competitors) = 0
-- name: run_all_enrichment
SELECT enrichment_id, customer_id, source_table, source_id, sentiment_score, sentiment_label, competitors,
       cancellation_intent, classification, summary FROM e_row
UNION ALL
SELECT 'ENR-SUM-' || customer_id, customer_id, 'CUSTOMER', customer_id, NULL, NULL, NULL, NULL, NULL, summary FROM d_summary
-- name: run_all_enrichment_again
SELECT * FROM (
  SELECT enrichment_id, customer_id, source_table, source_id, sentiment_score, sentiment_label, competitors,
         cancellation_intent, classification, summary FROM e_row
  UNION ALL
  SELECT 'ENR-SUM-' || customer_id, customer_id, 'CUSTOMER', customer_id, NULL, NULL, NULL, NULL, NULL, summary FROM d_summary
) WHERE md5(enrichment_id)[1] >= '8'
-- name: enrichment_wide
SELECT kind AS source_table, source_id, customer_id, score AS sentiment_score, label AS sentiment_label,
       CASE WHEN is_call THEN array_to_string(competitors, ',') END AS competitors, cancellation_intent,
       CASE WHEN is_call THEN klass END AS classification
FROM t_signal
-- name: events_policy
SELECT event_id, customer_id, event_type, strftime(event_at, '%Y-%m-%d %H:%M:%S') AS event_timestamp, source_table, source_id,
       policy_type AS event_payload_policy_type, premium_amount AS event_payload_premium, status AS event_payload_status
FROM v_event JOIN (SELECT policy_id, policy_type, premium_amount, status FROM m_policy) ON policy_id = source_id
WHERE source_table = 'POLICY'
-- name: events_claim
SELECT event_id, customer_id, event_type, strftime(event_at, '%Y-%m-%d %H:%M:%S') AS event_timestamp, source_table, source_id,
       claim_type AS event_payload_claim_type, claim_amount AS event_payload_amount, status AS event_payload_status,
       resolution_days::VARCHAR AS event_payload_resolution_days
FROM v_event JOIN (SELECT claim_id, claim_type, claim_amount, status, resolution_days FROM m_claim) ON claim_id = source_id
WHERE source_table = 'CLAIM'
-- name: events_payment
SELECT event_id, customer_id, event_type, strftime(event_at, '%Y-%m-%d %H:%M:%S') AS event_timestamp, source_table, source_id,
       amount AS event_payload_amount, status AS event_payload_status, payment_method AS event_payload_method,
       failure_reason AS event_payload_failure_reason
FROM v_event JOIN (SELECT payment_id, amount, status, payment_method, failure_reason FROM m_payment) ON payment_id = source_id
WHERE source_table = 'PAYMENT'
-- name: events_interaction
SELECT event_id, customer_id, event_type, strftime(event_at, '%Y-%m-%d %H:%M:%S') AS event_timestamp, source_table, source_id,
       channel AS event_payload_channel, direction AS event_payload_direction, topic AS event_payload_topic,
       disposition AS event_payload_disposition
FROM v_event JOIN (SELECT interaction_id, channel, direction, topic, disposition FROM m_interaction) ON interaction_id = source_id
WHERE source_table = 'INTERACTION'
-- name: events_survey
SELECT event_id, customer_id, event_type, strftime(event_at, '%Y-%m-%d %H:%M:%S') AS event_timestamp, source_table, source_id,
       survey_type AS event_payload_survey_type, nps_score::INTEGER AS event_payload_nps_score, csat_score::INTEGER AS event_payload_csat_score
FROM v_event JOIN (SELECT survey_id, survey_type, nps_score, csat_score FROM m_survey) ON survey_id = source_id
WHERE source_table = 'SURVEY'
-- name: customer_events
SELECT event_id, customer_id, event_type, strftime(event_at, '%Y-%m-%d %H:%M:%S') AS event_timestamp, source_table, source_id FROM v_event
-- name: moment_churn_competitor
SELECT moment_id, customer_id, moment_type, confidence, source_event_id, strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at,
       detail::INTEGER AS context_renewal_days
FROM o_moment WHERE moment_id LIKE 'MOM-CHR-%'
-- name: moment_churn_intent
SELECT moment_id, customer_id, moment_type, confidence, source_event_id, strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at,
       detail::DOUBLE AS context_sentiment_score
FROM o_moment WHERE moment_id LIKE 'MOM-CHR2-%'
-- name: moment_claim_friction
SELECT moment_id, customer_id, moment_type, confidence, source_event_id, strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at,
       substr(source_event_id, 9) AS context_claim_id, detail::INTEGER AS context_days_open
FROM o_moment WHERE moment_type = 'CLAIM_FRICTION'
-- name: moment_price_sensitivity
SELECT moment_id, customer_id, moment_type, confidence, source_event_id, strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at
FROM o_moment WHERE moment_type = 'PRICE_SENSITIVITY'
-- name: moments_every_row
SELECT 'MOM-CHR-' || customer_id || '-20240131000000' AS moment_id, customer_id, 'CHURN' AS moment_type, 0.85::DOUBLE AS confidence,
       row_id AS source_event_id, '2024-03-01 00:00:00' AS expires_at, renewal_days::INTEGER AS context_renewal_days
FROM (SELECT DISTINCT customer_id, row_id, renewal_days FROM o_m1_all)
UNION ALL
SELECT 'MOM-CHR2-' || customer_id || '-20240131000000', customer_id, 'CHURN', 0.9, row_id, '2024-02-14 00:00:00', NULL FROM o_m2_all
UNION ALL
SELECT moment_id, customer_id, moment_type, confidence, source_event_id, '2024-02-07 00:00:00', NULL FROM o_moment WHERE moment_type = 'CLAIM_FRICTION'
UNION ALL
SELECT 'MOM-PS-' || customer_id || '-20240131000000', customer_id, 'PRICE_SENSITIVITY', 0.75, intents_row, '2024-03-01 00:00:00', NULL
FROM t_signal WHERE price_sensitivity
-- name: customer_moments
SELECT moment_id, customer_id, moment_type, confidence, source_event_id, strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at FROM o_moment
-- name: active_moments
SELECT customer_id, moment_id, moment_type, confidence, '2024-01-31 00:00:00' AS detected_at FROM o_moment WHERE expires_on > DATE '2024-01-31'
-- name: agg_sentiment
SELECT customer_id, avg_sentiment, sentiment_count FROM s_customer
-- name: agg_claims
SELECT customer_id, total_claims, open_claims, denied_claims, round(avg_resolution::DECIMAL(28,8), 6)::DOUBLE AS avg_resolution FROM h_claims
-- name: agg_payments
SELECT customer_id, total_payments, failed_payments, round(failure_rate::DECIMAL(28,8), 6)::DOUBLE AS failure_rate FROM h_payments
-- name: agg_engagement
SELECT customer_id, interaction_count, strftime(last_interaction, '%Y-%m-%d %H:%M:%S') AS last_interaction,
       days_since_last::INTEGER AS days_since_last FROM h_engagement
-- name: agg_moments
SELECT customer_id, count(*) FILTER (moment_type = 'CHURN') AS churn_moments, count(*) AS total_moments FROM o_moment GROUP BY 1
-- name: score_sentiment
SELECT customer_id, round(s::DECIMAL(28,8), 4)::DOUBLE AS score FROM h_part
-- name: score_claims
SELECT customer_id, round(c::DECIMAL(28,8), 4)::DOUBLE AS score FROM h_part
-- name: score_payment
SELECT customer_id, round(p::DECIMAL(28,8), 4)::DOUBLE AS score FROM h_part
-- name: score_engagement
SELECT customer_id, e::DOUBLE AS score FROM h_part
-- name: churn_risk
SELECT customer_id, churn_risk FROM o_health
-- name: risk_level
SELECT customer_id, risk_level FROM o_health
-- name: customer_health
SELECT *, '2024-01-31 00:00:00' AS scored_at FROM o_health
-- name: run_events_moments_health
SELECT 'customer_event' AS table_name, count(*) AS row_count FROM v_event
UNION ALL SELECT 'customer_moment', count(*) FROM o_moment
UNION ALL SELECT 'customer_health', count(*) FROM o_health
-- name: health_apply_delta
SELECT h.customer_id,
       CASE WHEN hit THEN round(greatest(0, health_score - 10)::DECIMAL(28,8), 2)::DOUBLE ELSE health_score END AS health_score,
       CASE WHEN hit THEN round(least(1, churn_risk + 0.15::DOUBLE)::DECIMAL(28,8), 4)::DOUBLE ELSE churn_risk END AS churn_risk,
       CASE WHEN hit THEN round(greatest(0, least(100, coalesce(avg_sentiment, 0) * 25 + 50))::DECIMAL(28,8), 6)::DOUBLE ELSE sentiment_score END AS sentiment_score,
       claims_score, payment_score, engagement_score,
       CASE WHEN NOT hit THEN risk_level WHEN churn_risk >= 0.5499 THEN 'CRITICAL' WHEN churn_risk >= 0.2499 THEN 'AT_RISK'
            WHEN churn_risk >= 0.0499 THEN 'MONITOR' ELSE 'HEALTHY' END AS risk_level,
       '2024-01-31 00:00:00' AS scored_at
FROM (SELECT *, EXISTS (SELECT 1 FROM m_interaction i WHERE i.customer_id = o_health.customer_id AND topic = 'Complaint') AS hit FROM o_health) h
LEFT JOIN s_customer s ON s.customer_id = h.customer_id
-- name: health_maintained
, k_claim AS (
  SELECT customer_id, CASE WHEN status = 'Open' THEN 'Settled' ELSE status END AS status,
         CASE WHEN status = 'Open' THEN 20 ELSE resolution_days END AS resolution_days FROM m_claim
),
k_fact AS (
  SELECT customer_id, avg_sentiment, open_claims, denied_claims, avg_resolution, failure_rate, days_since_last,
         customer_id IN (SELECT customer_id FROM t_signal WHERE score < -0.3 AND cancellation_intent)
         OR (customer_id IN (SELECT customer_id FROM t_signal WHERE is_call AND len(competitors) > 0)
             AND customer_id IN (SELECT customer_id FROM m_policy WHERE status = 'Active' AND policy_type <> 'Auto'
                                 AND date_diff('day', DATE '2024-01-31', end_date) BETWEEN 1 AND 45)) AS has_churn
  FROM m_customer
  LEFT JOIN s_customer USING (customer_id)
  LEFT JOIN (SELECT customer_id, count(*) FILTER (status IN ('Open', 'Under Review')) AS open_claims, count(*) FILTER (status = 'Denied') AS denied_claims,
                    sum(resolution_days)::DOUBLE / nullif(count(resolution_days), 0) AS avg_resolution FROM k_claim GROUP BY 1) USING (customer_id)
  LEFT JOIN (SELECT DISTINCT customer_id, 0::DOUBLE AS failure_rate FROM m_payment) USING (customer_id)
  LEFT JOIN (SELECT customer_id, date_diff('day', max(interaction_date)::DATE, DATE '2024-01-31') AS days_since_last
             FROM m_interaction WHERE topic <> 'Complaint' GROUP BY 1) USING (customer_id)
),
k_part AS (
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
  FROM k_fact
)
SELECT customer_id,
       round((s * 0.25::DOUBLE + c * 0.2::DOUBLE + p * 0.2::DOUBLE + e * 0.15::DOUBLE
              + (1::DOUBLE - churn_pct::DOUBLE / 100) * 100 * 0.2::DOUBLE)::DECIMAL(28,8), 2)::DOUBLE AS health_score,
       churn_pct::DOUBLE / 100 AS churn_risk,
       round(s::DECIMAL(28,8), 2)::DOUBLE AS sentiment_score, round(c::DECIMAL(28,8), 2)::DOUBLE AS claims_score,
       round(p::DECIMAL(28,8), 2)::DOUBLE AS payment_score, round(e::DECIMAL(28,8), 2)::DOUBLE AS engagement_score,
       CASE WHEN churn_pct >= 70 THEN 'CRITICAL' WHEN churn_pct >= 40 THEN 'AT_RISK' WHEN churn_pct >= 20 THEN 'MONITOR' ELSE 'HEALTHY' END AS risk_level,
       '2024-01-31 00:00:00' AS scored_at
FROM k_part
-- name: health_change
SELECT customer_id, health_score AS health_before, churn_risk AS churn_before, risk_level AS risk_before,
       CASE WHEN hit THEN round(greatest(0, health_score - 10)::DECIMAL(28,8), 2)::DOUBLE ELSE health_score END AS health_after,
       CASE WHEN hit THEN round(least(1, churn_risk + 0.15::DOUBLE)::DECIMAL(28,8), 4)::DOUBLE ELSE churn_risk END AS churn_after,
       CASE WHEN NOT hit THEN risk_level WHEN churn_risk >= 0.5499 THEN 'CRITICAL' WHEN churn_risk >= 0.2499 THEN 'AT_RISK'
            WHEN churn_risk >= 0.0499 THEN 'MONITOR' ELSE 'HEALTHY' END AS risk_after,
       CASE WHEN hit THEN round((greatest(0, health_score - 10) - health_score)::DECIMAL(28,8), 1)::DOUBLE ELSE 0 END AS health_delta,
       CASE WHEN hit THEN round(((least(1, churn_risk + 0.15::DOUBLE) - churn_risk) * 100)::DECIMAL(28,8), 1)::DOUBLE ELSE 0 END AS churn_delta_pct
FROM (SELECT *, customer_id IN (SELECT customer_id FROM m_interaction WHERE topic = 'Complaint') AS hit FROM o_health)
-- name: nba_clear_pending
SELECT action_id, customer_id, action_type, confidence, rationale, priority, status, suppressed, suppression_reason,
       strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at FROM n_kept
-- name: nba_retention_offer
SELECT action_id, a.customer_id, action_type, confidence, rationale, priority, 'PENDING' AS status, FALSE AS suppressed, suppression_reason,
       strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at, churn_risk AS evidence_churn_risk, sentiment_score AS evidence_sentiment,
       renewal_days::INTEGER AS evidence_renewal_days
FROM n_new a JOIN n_ret r ON r.customer_id = a.customer_id WHERE action_type = 'RETENTION_OFFER'
-- name: nba_claims_escalation
SELECT action_id, a.customer_id, action_type, confidence, rationale, priority, 'PENDING' AS status, FALSE AS suppressed, suppression_reason,
       strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at, claim_id AS evidence_claim_id, days_open::INTEGER AS evidence_days_open,
       claim_amount AS evidence_claim_amount, sentiment_score AS evidence_sentiment
FROM n_new a JOIN n_clm c ON action_id = 'NBA-CLM-' || c.customer_id || '-' || claim_id
-- name: nba_competitor_campaign
SELECT action_id, a.customer_id, action_type, confidence, rationale, priority, 'PENDING' AS status, FALSE AS suppressed, suppression_reason,
       strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at, renewal_days::INTEGER AS evidence_renewal_days,
       array_to_string(r.competitors, ',') AS competitors
FROM n_new a JOIN n_crc r ON r.customer_id = a.customer_id WHERE action_type = 'COMPETITOR_RETENTION_CAMPAIGN'
-- name: nba_cross_sell
SELECT action_id, a.customer_id, action_type, confidence, rationale, priority,
       CASE WHEN reason IS NULL THEN 'PENDING' ELSE 'SUPPRESSED' END AS status, reason IS NOT NULL AS suppressed, reason AS suppression_reason,
       strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at, segment AS evidence_segment, sentiment_score AS evidence_sentiment,
       health_score AS evidence_health_score
FROM n_new a JOIN n_xsl x ON x.customer_id = a.customer_id WHERE action_type = 'CROSS_SELL'
-- name: nba_suppression
SELECT CASE WHEN reason IS NULL THEN 'PENDING' ELSE 'SUPPRESSED' END AS status, reason AS suppression_reason, count(*) AS actions
FROM n_xsl GROUP BY ALL
-- name: nba_payment_assistance
SELECT action_id, a.customer_id, action_type, confidence, rationale, priority, 'PENDING' AS status, FALSE AS suppressed, suppression_reason,
       strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at, failed::INTEGER AS evidence_failed_payments, total::INTEGER AS evidence_total_payments,
       round((failed::DOUBLE / total)::DECIMAL(28,8), 3)::DOUBLE AS evidence_failure_rate
FROM n_new a JOIN n_pay p ON p.customer_id = a.customer_id WHERE action_type = 'PAYMENT_ASSISTANCE'
-- name: nba_generate
SELECT action_id, customer_id, action_type, confidence, rationale, priority, status, suppressed, suppression_reason,
       strftime(created_on, '%Y-%m-%d 00:00:00') AS created_at, strftime(expires_on, '%Y-%m-%d 00:00:00') AS expires_at FROM o_action
-- name: nba_decide
SELECT action_id, customer_id, action_type,
       CASE WHEN status = 'PENDING' AND decision <> 'MAYBE' THEN decision ELSE status END AS status
FROM o_action JOIN w_decision USING (action_id)
-- name: nba_decision_log
SELECT log_id, action_id, customer_id, action_type, decision, decided_by, '2024-01-31 00:00:00' AS decided_at FROM o_log
-- name: nba_record_outcome
SELECT log_id, action_id, decision, outcome, CASE WHEN outcome IS NOT NULL THEN '2024-01-31 00:00:00' END AS outcome_date, notes,
       CASE WHEN decision = 'APPROVED' AND outcome IS NOT NULL THEN 'COMPLETED' ELSE decision END AS status
FROM o_log
-- name: customer_nba
SELECT customer_id, action_id, action_type, confidence, rationale, priority, status, strftime(created_on, '%Y-%m-%d 00:00:00') AS created_at
FROM o_action WHERE NOT suppressed AND expires_on > DATE '2024-01-31'
-- name: evidence_source
SELECT doc_id, customer_id, source_type, content, sentiment, moment_type, strftime(written_on, '%Y-%m-%d 00:00:00') AS event_date FROM x_doc
-- name: evidence_source_joined
SELECT doc_id, customer_id, source_type, sentiment, moment_type, strftime(written_on, '%Y-%m-%d 00:00:00') AS event_date FROM x_doc
-- name: evidence_source_colocated
SELECT doc_id, customer_id, source_type, sentiment, moment_type, strftime(written_on, '%Y-%m-%d 00:00:00') AS event_date FROM x_doc
-- name: evidence_index
SELECT term, doc_id, count(*) AS tf, customer_id, source_type, sentiment, moment_type
FROM (SELECT unnest(w) AS term, doc_id, customer_id, source_type, sentiment, moment_type FROM x_word) GROUP BY ALL
-- name: evidence_search
, b_doc AS (SELECT x.*, len(w) AS dl FROM x_word x),
b_tf AS (SELECT doc_id, dl, q AS term, len(list_filter(w, lambda t: t = q)) AS tf FROM b_doc, (VALUES ('stupid'), ('worthless'), ('license'), ('onwh')) v(q)),
b_gain AS (
  SELECT doc_id, round(ln(1 + ((SELECT count(*) FROM b_doc) - df + 0.5) / (df + 0.5))
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM b_doc))), 9)::DECIMAL(18,9) AS gain
  FROM b_tf JOIN (SELECT term, count(*) FILTER (tf > 0) AS df FROM b_tf GROUP BY 1) USING (term)
),
b_top AS (SELECT doc_id, round(sum(gain), 6)::DOUBLE AS score FROM b_gain GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 5)
SELECT doc_id, score, customer_id, source_type, sentiment, moment_type, strftime(written_on, '%Y-%m-%d 00:00:00') AS event_date, content
FROM b_top JOIN x_doc USING (doc_id)
-- name: evidence_search_index
, b_doc AS (SELECT x.*, len(w) AS dl FROM x_word x),
b_tf AS (SELECT doc_id, dl, q AS term, len(list_filter(w, lambda t: t = q)) AS tf FROM b_doc, (VALUES ('stupid'), ('worthless'), ('license'), ('onwh')) v(q)),
b_gain AS (
  SELECT doc_id, round(ln(1 + ((SELECT count(*) FROM b_doc) - df + 0.5) / (df + 0.5))
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM b_doc))), 9)::DECIMAL(18,9) AS gain
  FROM b_tf JOIN (SELECT term, count(*) FILTER (tf > 0) AS df FROM b_tf GROUP BY 1) USING (term)
),
b_top AS (SELECT doc_id, round(sum(gain), 6)::DOUBLE AS score FROM b_gain GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 5)
SELECT doc_id, score, customer_id, source_type, sentiment, moment_type, strftime(written_on, '%Y-%m-%d 00:00:00') AS event_date
FROM b_top JOIN x_doc USING (doc_id)
-- name: evidence_search_filtered
, b_doc AS (
  SELECT x.*, len(w) AS dl FROM x_word x
  WHERE sentiment = 'NEGATIVE' AND source_type = 'TRANSCRIPT' AND written_on BETWEEN DATE '2023-10-01' AND DATE '2024-01-15'
),
b_tf AS (SELECT doc_id, dl, q AS term, len(list_filter(w, lambda t: t = q)) AS tf FROM b_doc, (VALUES ('stupid'), ('worthless'), ('license'), ('onwh')) v(q)),
b_gain AS (
  SELECT doc_id, round(ln(1 + ((SELECT count(*) FROM b_doc) - df + 0.5) / (df + 0.5))
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM b_doc))), 9)::DECIMAL(18,9) AS gain
  FROM b_tf JOIN (SELECT term, count(*) FILTER (tf > 0) AS df FROM b_tf GROUP BY 1) USING (term)
),
b_top AS (SELECT doc_id, round(sum(gain), 6)::DOUBLE AS score FROM b_gain GROUP BY 1 HAVING sum(gain) > 0 ORDER BY score DESC, doc_id LIMIT 5)
SELECT doc_id, score, customer_id, source_type, sentiment, moment_type, strftime(written_on, '%Y-%m-%d 00:00:00') AS event_date
FROM b_top JOIN x_doc USING (doc_id)
-- name: evidence_search_corpus
, b_doc AS (SELECT x.*, len(w) AS dl FROM x_word x),
b_tf AS (SELECT doc_id, dl, q AS term, len(list_filter(w, lambda t: t = q)) AS tf FROM b_doc, (VALUES ('stupid'), ('worthless'), ('license'), ('onwh')) v(q)),
b_gain AS (
  SELECT doc_id, round(ln(1 + ((SELECT count(*) FROM b_doc) - df + 0.5) / (df + 0.5))
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM b_doc))), 9)::DECIMAL(18,9) AS gain
  FROM b_tf JOIN (SELECT term, count(*) FILTER (tf > 0) AS df FROM b_tf GROUP BY 1) USING (term)
),
b_top AS (SELECT doc_id, round(sum(gain), 6)::DOUBLE AS score FROM b_gain GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 5)
SELECT doc_id, score, customer_id, source_type, sentiment, moment_type, strftime(written_on, '%Y-%m-%d 00:00:00') AS event_date, content
FROM b_top JOIN x_doc USING (doc_id)
-- name: evidence_postings_read
, b_doc AS (SELECT x.*, len(w) AS dl FROM x_word x),
b_tf AS (SELECT doc_id, dl, q AS term, len(list_filter(w, lambda t: t = q)) AS tf FROM b_doc, (VALUES ('stupid'), ('worthless'), ('license'), ('onwh')) v(q)),
b_gain AS (
  SELECT doc_id, round(ln(1 + ((SELECT count(*) FROM b_doc) - df + 0.5) / (df + 0.5))
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM b_doc))), 9)::DECIMAL(18,9) AS gain
  FROM b_tf JOIN (SELECT term, count(*) FILTER (tf > 0) AS df FROM b_tf GROUP BY 1) USING (term)
),
b_top AS (SELECT doc_id, round(sum(gain), 6)::DOUBLE AS score FROM b_gain GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 5)
SELECT doc_id, score, true AS below_half FROM b_top
-- name: customer_evidence
SELECT customer_id, doc_id, source_type, left(content, 300) AS content_preview, sentiment, moment_type,
       strftime(written_on, '%Y-%m-%d 00:00:00') AS event_date
FROM x_doc QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY written_on DESC, doc_id) <= 10
-- name: action_evidence
SELECT action_id, a.customer_id, action_type, doc_id, source_type, sentiment, moment_type,
       strftime(written_on, '%Y-%m-%d 00:00:00') AS event_date, evidence_rank
FROM o_action a JOIN (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY written_on DESC, doc_id)::INTEGER AS evidence_rank FROM x_doc
) e ON e.customer_id = a.customer_id
WHERE status = 'PENDING' AND evidence_rank <= 3
-- name: copilot_context
, b_doc AS (SELECT x.*, len(w) AS dl FROM x_word x),
b_tf AS (SELECT doc_id, dl, q AS term, len(list_filter(w, lambda t: t = q)) AS tf FROM b_doc, (VALUES ('stupid'), ('worthless'), ('license'), ('onwh')) v(q)),
b_gain AS (
  SELECT doc_id, round(ln(1 + ((SELECT count(*) FROM b_doc) - df + 0.5) / (df + 0.5))
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM b_doc))), 9)::DECIMAL(18,9) AS gain
  FROM b_tf JOIN (SELECT term, count(*) FILTER (tf > 0) AS df FROM b_tf GROUP BY 1) USING (term)
),
b_top AS (SELECT doc_id, round(sum(gain), 6)::DOUBLE AS score FROM b_gain GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 5)
SELECT string_agg('[' || source_type || '] (Customer: ' || customer_id || ', Sentiment: ' || sentiment || '): ' || left(content, 300),
                  chr(10) || chr(10) ORDER BY score DESC, doc_id) AS context
FROM b_top JOIN x_doc USING (doc_id)
-- name: customer_360
SELECT c.customer_id, coalesce(i.page, 0)::INTEGER AS page, first_name || ' ' || last_name AS name, segment, region, tenure_months,
       health_score, risk_level, coalesce(n_moments, 0)::INTEGER AS n_moments, coalesce(n_policies, 0)::INTEGER AS n_policies,
       coalesce(n_claims, 0)::INTEGER AS n_claims, coalesce(claim_cents, 0)::BIGINT AS claim_cents
FROM m_customer c LEFT JOIN o_health h USING (customer_id)
LEFT JOIN (
  SELECT customer_id, page, count(*) FILTER (kind = 'm') AS n_moments, count(*) FILTER (kind = 'p') AS n_policies,
         count(*) FILTER (kind = 'c') AS n_claims, sum(cents) AS claim_cents
  FROM (
    SELECT *, (row_number() OVER (PARTITION BY customer_id ORDER BY md5(item_id), item_id) - 1) // 10000 AS page
    FROM (
      SELECT customer_id, moment_id AS item_id, 'm' AS kind, 0 AS cents FROM o_moment WHERE expires_on > DATE '2024-01-31'
      UNION ALL SELECT customer_id, policy_id, 'p', 0 FROM m_policy
      UNION ALL SELECT customer_id, claim_id, 'c', round(claim_amount * 100)::BIGINT FROM m_claim WHERE filed_date >= DATE '2023-07-31'
    )
  ) GROUP BY 1, 2
) i USING (customer_id)
-- name: customer_360_small_pages
SELECT c.customer_id, coalesce(i.page, 0)::INTEGER AS page, coalesce(n_moments, 0)::INTEGER AS n_moments, coalesce(ids, '') AS item_ids
FROM m_customer c
LEFT JOIN (
  SELECT customer_id, page, count(*) FILTER (kind = 'm') AS n_moments, string_agg(item_id, ',' ORDER BY item_id) FILTER (kind <> 'm') AS ids
  FROM (
    SELECT *, (row_number() OVER (PARTITION BY customer_id ORDER BY md5(item_id), item_id) - 1) // 3 AS page
    FROM (
      SELECT customer_id, moment_id AS item_id, 'm' AS kind FROM o_moment WHERE expires_on > DATE '2024-01-31'
      UNION ALL SELECT customer_id, policy_id, 'p' FROM m_policy
      UNION ALL SELECT customer_id, claim_id, 'c' FROM m_claim WHERE filed_date >= DATE '2023-07-31'
    )
  ) GROUP BY 1, 2
) i USING (customer_id)
-- name: nba_recommendation
SELECT customer_id, page::INTEGER AS page, count(*)::INTEGER AS n_actions, string_agg(action_id, ',' ORDER BY action_id) AS action_ids
FROM (
  SELECT customer_id, action_id, (row_number() OVER (PARTITION BY customer_id ORDER BY md5(action_id), action_id) - 1) // 10000 AS page
  FROM o_action WHERE NOT suppressed AND status = 'PENDING' AND expires_on > DATE '2024-01-31'
) GROUP BY 1, 2
-- name: customer_profile
SELECT customer_id, first_name, last_name, gender, segment, region, state, tenure_months, lifetime_value, health_score, churn_risk,
       risk_level, sentiment_score, claims_score, payment_score, engagement_score
FROM m_customer LEFT JOIN o_health USING (customer_id)
-- name: customer_policies
SELECT customer_id, policy_id, policy_type, premium_amount, status, strftime(start_date, '%Y-%m-%d') AS start_date,
       strftime(end_date, '%Y-%m-%d') AS end_date FROM m_policy
-- name: customer_claims
SELECT customer_id, claim_id, claim_type, claim_amount, status, strftime(filed_date, '%Y-%m-%d') AS filed_date, resolution_days FROM m_claim
-- name: customer_timeline
SELECT customer_id, event_id, event_type, strftime(event_at, '%Y-%m-%d %H:%M:%S') AS event_timestamp, source_table, source_id
FROM v_event QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_at DESC, event_id) <= 50
-- name: customer_payments
SELECT customer_id, payment_id, amount, strftime(payment_date, '%Y-%m-%d') AS payment_date, status, payment_method, failure_reason FROM m_payment
-- name: customer_interactions
SELECT customer_id, interaction_id, channel, direction, strftime(interaction_date, '%Y-%m-%d %H:%M:%S') AS interaction_date, topic, disposition
FROM m_interaction
-- name: customer_actions
SELECT customer_id, action_id, action_type, confidence, rationale, priority, status FROM o_action WHERE NOT suppressed
-- name: customer_health_state
SELECT customer_id, health_score, churn_risk, risk_level, sentiment_score, engagement_score FROM o_health
-- name: sem_health_file
SELECT risk_level, region, count(DISTINCT customer_id) AS customer_count, round(avg(health_score)::DECIMAL(28,8), 6)::DOUBLE AS avg_health_score,
       round(avg(churn_risk)::DECIMAL(28,8), 6)::DOUBLE AS avg_churn_risk,
       round((count(*) FILTER (churn_risk >= 0.4::DOUBLE) / count(*))::DECIMAL(28,8), 6)::DOUBLE AS churn_rate,
       count(*) FILTER (risk_level = 'CRITICAL') AS critical_customers, round(avg(sentiment_score)::DECIMAL(28,8), 6)::DOUBLE AS avg_sentiment,
       round(avg(payment_score)::DECIMAL(28,8), 6)::DOUBLE AS avg_payment_score,
       round(avg(engagement_score)::DECIMAL(28,8), 6)::DOUBLE AS avg_engagement_score
FROM o_health JOIN (SELECT customer_id, region FROM m_customer) USING (customer_id) GROUP BY 1, 2
-- name: sem_health
SELECT risk_level, region, count(DISTINCT customer_id) AS customer_count, round(avg(health_score)::DECIMAL(28,8), 6)::DOUBLE AS avg_health_score,
       round(avg(churn_risk)::DECIMAL(28,8), 6)::DOUBLE AS avg_churn_risk,
       round((count(*) FILTER (churn_risk >= 0.4::DOUBLE) / count(*))::DECIMAL(28,8), 6)::DOUBLE AS churn_rate,
       count(*) FILTER (risk_level = 'CRITICAL') AS critical_customers, round(avg(sentiment_score)::DECIMAL(28,8), 6)::DOUBLE AS avg_sentiment,
       round(avg(payment_score)::DECIMAL(28,8), 6)::DOUBLE AS avg_payment_score,
       round(avg(engagement_score)::DECIMAL(28,8), 6)::DOUBLE AS avg_engagement_score
FROM o_health JOIN (SELECT customer_id, region FROM m_customer) USING (customer_id) GROUP BY 1, 2
-- name: sem_customer
SELECT segment, region, gender, count(*) AS total_customers, round(avg(tenure_months)::DECIMAL(28,8), 6)::DOUBLE AS avg_tenure_months,
       round(avg(lifetime_value)::DECIMAL(28,8), 6)::DOUBLE AS avg_lifetime_value,
       round(sum(lifetime_value)::DECIMAL(28,8), 4)::DOUBLE AS total_lifetime_value
FROM m_customer GROUP BY 1, 2, 3
-- name: sem_policy
SELECT policy_type, status, count(DISTINCT policy_id) AS policy_count, round(avg(premium_amount)::DECIMAL(28,8), 6)::DOUBLE AS avg_premium,
       round(sum(premium_amount)::DECIMAL(28,8), 4)::DOUBLE AS total_premium, count(*) FILTER (status = 'Active') AS active_policies
FROM m_policy GROUP BY 1, 2
-- name: sem_policy_by_day
SELECT strftime(start_date, '%Y-%m-%d') AS start_date, count(DISTINCT policy_id) AS policy_count,
       round(sum(premium_amount)::DECIMAL(28,8), 4)::DOUBLE AS total_premium
FROM m_policy WHERE status = 'Active' GROUP BY 1 ORDER BY round(sum(premium_amount)::DECIMAL(28,8), 4) DESC, 1 LIMIT 25
-- name: sem_nba_log
SELECT action_type, decided_by, count(DISTINCT action_id) AS action_count,
       round((count(*) FILTER (decision = 'APPROVED') / count(*))::DECIMAL(28,8), 6)::DOUBLE AS approval_rate,
       round((count(*) FILTER (decision = 'REJECTED') / count(*))::DECIMAL(28,8), 6)::DOUBLE AS rejection_rate,
       round((count(*) FILTER (outcome = 'SUCCESSFUL') / nullif(count(outcome), 0))::DECIMAL(28,8), 6)::DOUBLE AS effectiveness
FROM o_log GROUP BY 1, 2
-- name: sem_view
SELECT segment, region, customer_count, avg_health, avg_churn_risk, critical_count, action_count
FROM (SELECT segment, region, count(*) AS customer_count, round(avg(health_score)::DECIMAL(28,8), 6)::DOUBLE AS avg_health,
             round(avg(churn_risk)::DECIMAL(28,8), 6)::DOUBLE AS avg_churn_risk, count(*) FILTER (risk_level = 'CRITICAL') AS critical_count
      FROM o_health JOIN (SELECT customer_id, segment, region FROM m_customer) USING (customer_id) GROUP BY 1, 2)
FULL JOIN (SELECT segment, region, count(DISTINCT action_id) AS action_count
           FROM o_action JOIN (SELECT customer_id, segment, region FROM m_customer) USING (customer_id) GROUP BY 1, 2) USING (segment, region)
-- name: sem_claims_by_holder
, k_policy AS (
  SELECT policy_id, policy_type, segment FROM m_policy p LEFT JOIN m_customer c ON c.customer_id = p.customer_id
)
SELECT segment, policy_type, claim_count, round(amount::DECIMAL(28,8), 6)::DOUBLE AS claimed_amount, round((amount / claim_count)::DECIMAL(28,8), 6)::DOUBLE AS avg_claim,
       largest_claim, round(open_share::DECIMAL(28,8), 6)::DOUBLE AS open_share, policies
FROM (SELECT segment, policy_type, count(*) AS claim_count, sum(round(l_extendedprice * 1000000)::HUGEINT)::DOUBLE / 1000000 AS amount,
             max(l_extendedprice) AS largest_claim, avg((l_partkey % 20 <= 1)::INTEGER) AS open_share
      FROM m_line l LEFT JOIN k_policy p ON p.policy_id = 'POL-' || lpad(l_orderkey::VARCHAR, greatest(7, length(l_orderkey::VARCHAR))::INTEGER, '0')
      WHERE l_returnflag = 'R' GROUP BY 1, 2)
FULL JOIN (SELECT segment, policy_type, count(*) AS policies FROM k_policy GROUP BY 1, 2) USING (segment, policy_type)
-- name: sem_view_actions
SELECT action_type, status AS nba_status, segment, count(DISTINCT action_id) AS action_count
FROM o_action JOIN (SELECT customer_id, segment FROM m_customer) USING (customer_id) GROUP BY 1, 2, 3
-- name: portfolio_kpis
SELECT count(*) AS total_customers,
       round((sum(round(health_score * 100)::BIGINT)::DOUBLE / 100 / count(*))::DECIMAL(28,8), 1)::DOUBLE AS avg_health,
       round((sum(round(churn_risk * 10000)::BIGINT)::DOUBLE / 10000 / count(*) * 100)::DECIMAL(28,8), 1)::DOUBLE AS avg_churn_pct,
       count(*) FILTER (risk_level = 'CRITICAL') AS critical_count, count(*) FILTER (risk_level = 'AT_RISK') AS at_risk_count
FROM o_health
-- name: risk_distribution
SELECT risk_level, count(*) AS customers FROM o_health GROUP BY 1
-- name: health_by_segment
SELECT segment, round((sum(round(health_score * 100)::BIGINT)::DOUBLE / 100 / count(*))::DECIMAL(28,8), 1)::DOUBLE AS avg_health,
       count(*) AS customer_count
FROM m_customer JOIN o_health USING (customer_id) GROUP BY 1
-- name: critical_customers
SELECT customer_id, health_score, churn_risk, risk_level, sentiment_score, first_name || ' ' || last_name AS name, segment
FROM o_health JOIN m_customer USING (customer_id) WHERE risk_level = 'CRITICAL' ORDER BY churn_risk DESC, customer_id LIMIT 20
-- name: portfolio_context
SELECT 'Portfolio: ' || count(*) || ' customers, ' || count(*) FILTER (risk_level = 'CRITICAL') || ' critical, '
       || count(*) FILTER (risk_level = 'AT_RISK') || ' at-risk, avg health '
       || round((sum(round(health_score * 100)::BIGINT)::DOUBLE / 100 / count(*))::DECIMAL(18,8), 1)::DECIMAL(18,1)
       || ', avg churn ' || round((sum(round(churn_risk * 10000)::BIGINT)::DOUBLE / 10000 / count(*))::DECIMAL(18,8), 3)::DECIMAL(18,3) AS context
FROM o_health
-- name: nba_status_summary
SELECT count(*) AS total, count(*) FILTER (st = 'PENDING') AS pending, count(*) FILTER (st = 'APPROVED') AS approved,
       count(*) FILTER (st = 'REJECTED') AS rejected, count(*) FILTER (suppressed) AS suppressed
FROM (SELECT *, CASE WHEN status = 'PENDING' AND decision <> 'MAYBE' THEN decision ELSE status END AS st
      FROM o_action JOIN w_decision USING (action_id))
-- name: nba_queue
SELECT action_id, customer_id, first_name || ' ' || last_name AS customer_name, action_type, confidence, rationale, priority, status,
       strftime(created_on, '%Y-%m-%d 00:00:00') AS created_at
FROM o_action JOIN (SELECT customer_id, first_name, last_name FROM m_customer) USING (customer_id)
WHERE status = 'PENDING' AND NOT suppressed ORDER BY priority, confidence DESC, action_id LIMIT 50
-- name: nba_effectiveness
SELECT action_type, count(*) AS total, count(*) FILTER (decision = 'APPROVED') AS approved, count(*) FILTER (outcome = 'SUCCESSFUL') AS successful
FROM o_log GROUP BY 1
-- name: retention_metrics
SELECT c.segment, c.region, count(*) AS customers, coalesce(sum(n), 0)::BIGINT AS policies,
       round((sum(active) / sum(n))::DECIMAL(28,8), 4)::DOUBLE AS active_share,
       round((sum(cancelled) / sum(n))::DECIMAL(28,8), 4)::DOUBLE AS cancelled_share,
       round((count(*) FILTER (churn_risk >= 0.4::DOUBLE) / count(churn_risk))::DECIMAL(28,8), 4)::DOUBLE AS elevated_churn_share
FROM m_customer c LEFT JOIN o_health USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n, count(*) FILTER (status = 'Active') AS active, count(*) FILTER (status = 'Cancelled') AS cancelled
           FROM m_policy GROUP BY 1) USING (customer_id)
GROUP BY 1, 2
-- name: q_critical_now
SELECT customer_id, health_score, churn_risk, risk_level, sentiment_score, first_name || ' ' || last_name AS name, segment
FROM o_health JOIN m_customer USING (customer_id) WHERE risk_level = 'CRITICAL'
-- name: q_competitor_mentions
SELECT customer_id, competitor, count(*) AS mentions
FROM (SELECT customer_id, unnest(competitors) AS competitor FROM t_signal WHERE is_call AND written_on >= DATE '2024-01-01') GROUP BY 1, 2
-- name: q_pending_retention
SELECT action_id, customer_id, first_name || ' ' || last_name AS customer_name, action_type, confidence, rationale, priority, status,
       strftime(created_on, '%Y-%m-%d 00:00:00') AS created_at
FROM o_action JOIN (SELECT customer_id, first_name, last_name FROM m_customer) USING (customer_id)
WHERE status = 'PENDING' AND NOT suppressed AND action_type = 'RETENTION_OFFER'
-- name: q_stale_claims_negative
SELECT customer_id, claim_id, claim_type, claim_amount, status, days_open::INTEGER AS days_open, avg_sentiment FROM o_m3
-- name: q_friction_this_week
SELECT moment_id, customer_id, source_event_id, confidence FROM o_moment WHERE moment_type = 'CLAIM_FRICTION'
-- name: q_resolution_by_type
SELECT claim_type, round((sum(resolution_days)::DOUBLE / count(resolution_days))::DECIMAL(28,8), 2)::DOUBLE AS avg_resolution_days,
       count(resolution_days) AS resolved_claims FROM m_claim GROUP BY 1
-- name: q_customer_360
SELECT c.customer_id, first_name || ' ' || last_name AS name, health_score, risk_level,
       (SELECT count(*) FROM m_policy p WHERE p.customer_id = c.customer_id)::INTEGER AS n_policies,
       (SELECT count(*) FROM m_claim k WHERE k.customer_id = c.customer_id AND filed_date >= DATE '2023-07-31')::INTEGER AS n_claims,
       (SELECT count(*) FROM o_moment m WHERE m.customer_id = c.customer_id AND expires_on > DATE '2024-01-31')::INTEGER AS n_moments
FROM m_customer c LEFT JOIN o_health h ON h.customer_id = c.customer_id WHERE c.customer_id = 'CUST-000001'
-- name: q_top_contact_reasons
SELECT topic, count(*) AS contacts FROM m_interaction GROUP BY 1
-- name: q_payment_assistance
SELECT customer_id, first_name || ' ' || last_name AS customer_name, action_id, confidence, rationale
FROM o_action JOIN (SELECT customer_id, first_name, last_name FROM m_customer) USING (customer_id)
WHERE status = 'PENDING' AND NOT suppressed AND action_type = 'PAYMENT_ASSISTANCE'
-- name: q_critical_count
SELECT count(*) FILTER (risk_level = 'CRITICAL') AS critical_count FROM o_health
-- name: q_health_by_segment
SELECT segment, round(avg(health_score)::DECIMAL(28,8), 6)::DOUBLE AS avg_health FROM o_health JOIN m_customer USING (customer_id) GROUP BY 1
-- name: q_churn_by_region
SELECT region, round((count(*) FILTER (churn_risk >= 0.4::DOUBLE) / count(*))::DECIMAL(28,8), 6)::DOUBLE AS churn_rate
FROM o_health JOIN m_customer USING (customer_id) GROUP BY 1
-- name: check_volumes
SELECT 'CUSTOMER' AS table_name, (SELECT count(*) FROM m_customer) AS row_count, 10000::BIGINT AS target
UNION ALL SELECT 'POLICY', (SELECT count(*) FROM m_policy), 25000
UNION ALL SELECT 'CLAIM', (SELECT count(*) FROM m_claim), 15000
UNION ALL SELECT 'PAYMENT', (SELECT count(*) FROM m_payment), 60000
UNION ALL SELECT 'INTERACTION', (SELECT count(*) FROM m_interaction), 50000
UNION ALL SELECT 'TRANSCRIPT', (SELECT count(*) FROM m_doc WHERE kind = 'TRANSCRIPT'), 8000
UNION ALL SELECT 'EMAIL', (SELECT count(*) FROM m_doc WHERE kind = 'EMAIL'), 10000
UNION ALL SELECT 'NOTE', (SELECT count(*) FROM m_doc WHERE kind = 'NOTE'), 12000
UNION ALL SELECT 'SURVEY', (SELECT count(*) FROM m_survey), 5000
-- name: check_enrichment
SELECT 'AI_ENRICHMENT' AS check_name, count(*) AS total_enrichments, count(sentiment_score) AS with_sentiment, count(competitors) AS with_entities,
       count(cancellation_intent) AS with_intents, count(classification) AS with_classification, count(summary) AS with_summary
FROM (FROM e_row UNION ALL SELECT NULL, customer_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, summary FROM d_summary)
-- name: check_events
SELECT 'CUSTOMER_EVENTS' AS check_name, count(*) AS total_events, count(DISTINCT customer_id) AS unique_customers,
       count(DISTINCT event_type) AS unique_event_types, count(DISTINCT source_table) AS source_tables FROM v_event
-- name: check_moments
SELECT 'CUSTOMER_MOMENTS' AS check_name, count(*) AS total_moments, count(DISTINCT customer_id) AS affected_customers,
       count(*) FILTER (moment_type = 'CHURN') AS churn_moments, count(*) FILTER (moment_type = 'CLAIM_FRICTION') AS friction_moments,
       count(*) FILTER (moment_type = 'PRICE_SENSITIVITY') AS price_moments FROM o_moment
-- name: check_health
SELECT 'CUSTOMER_HEALTH' AS check_name, count(*) AS scored_customers,
       round((sum(round(health_score * 100)::BIGINT)::DOUBLE / 100 / count(*))::DECIMAL(28,8), 2)::DOUBLE AS avg_health,
       round((sum(round(churn_risk * 10000)::BIGINT)::DOUBLE / 10000 / count(*))::DECIMAL(28,8), 4)::DOUBLE AS avg_churn_risk,
       count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'AT_RISK') AS at_risk,
       count(*) FILTER (risk_level = 'MONITOR') AS monitor, count(*) FILTER (risk_level = 'HEALTHY') AS healthy FROM o_health
-- name: check_nba
SELECT 'NBA_RECOMMENDATIONS' AS check_name, count(*) AS total_actions, count(*) FILTER (action_type = 'RETENTION_OFFER') AS retention,
       count(*) FILTER (action_type = 'CLAIMS_ESCALATION') AS claims_esc, count(*) FILTER (action_type = 'COMPETITOR_RETENTION_CAMPAIGN') AS competitor_ret,
       count(*) FILTER (action_type = 'CROSS_SELL') AS cross_sell, count(*) FILTER (action_type = 'PAYMENT_ASSISTANCE') AS payment_assist,
       count(*) FILTER (suppressed) AS suppressed FROM o_action
-- name: check_customer
SELECT c.customer_id, first_name || ' ' || last_name AS name, segment, health_score, churn_risk, risk_level, coalesce(a.n, 0) AS policies,
       coalesce(b.n, 0) AS claims, coalesce(d.n, 0) AS interactions, coalesce(e.n, 0) AS moments, coalesce(f.n, 0) AS nbas
FROM m_customer c LEFT JOIN o_health USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n FROM m_policy GROUP BY 1) a USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n FROM m_claim GROUP BY 1) b USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n FROM m_interaction GROUP BY 1) d USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n FROM o_moment GROUP BY 1) e USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n FROM o_action WHERE NOT suppressed GROUP BY 1) f USING (customer_id)
-- name: check_evidence
SELECT 'EVIDENCE_SOURCE' AS check_name, count(*) AS total_documents, count(DISTINCT customer_id) AS unique_customers,
       count(DISTINCT source_type) AS source_types FROM x_doc
-- name: check_keys
, k_all AS (
  SELECT 'CUSTOMER' AS t, customer_id AS k, customer_id AS c FROM m_customer
  UNION ALL SELECT 'POLICY', policy_id, customer_id FROM m_policy
  UNION ALL SELECT 'CLAIM', claim_id, customer_id FROM m_claim
  UNION ALL SELECT 'PAYMENT', payment_id, customer_id FROM m_payment
  UNION ALL SELECT 'INTERACTION', interaction_id, customer_id FROM m_interaction
  UNION ALL SELECT kind, doc_id::VARCHAR, customer_id FROM m_doc
  UNION ALL SELECT 'SURVEY', survey_id, customer_id FROM m_survey
  UNION ALL SELECT 'CUSTOMER_EVENT', event_id, customer_id FROM v_event
  UNION ALL SELECT 'CUSTOMER_MOMENT', moment_id, customer_id FROM o_moment
  UNION ALL SELECT 'NEXT_BEST_ACTION', action_id, customer_id FROM o_action
)
SELECT t AS table_name, 'duplicate_keys' AS problem, count(*) FILTER (n > 1) AS value FROM (SELECT t, k, count(*) AS n FROM k_all GROUP BY 1, 2) GROUP BY 1
UNION ALL
SELECT t, 'unknown_customers', count(*) FILTER (c NOT IN (SELECT customer_id FROM m_customer)) FROM k_all GROUP BY 1
-- name: stream_customer_events
SELECT event_id, customer_id, event_type, strftime(event_at, '%Y-%m-%d %H:%M:%S') AS event_timestamp, source_table, source_id FROM v_event
-- name: stream_enrichment
SELECT enrichment_id, customer_id, source_table, source_id, sentiment_score, sentiment_label, classification FROM e_row WHERE source_table = 'TRANSCRIPT'
-- name: stream_evidence_refresh
SELECT doc_id, customer_id, source_type, sentiment, moment_type, len(w) AS dl FROM x_word
-- name: stream_evidence_changes
SELECT term, doc_id, count(*) AS tf FROM (
  SELECT unnest(CASE WHEN source_type = 'NOTE' THEN list_concat(['license', 'changed'], coalesce(w, [])) ELSE w END) AS term, doc_id
  FROM x_word WHERE source_type IN ('NOTE', 'SURVEY')
) WHERE term IN ('license', 'changed', 'stupid') GROUP BY ALL
-- name: ingest_interaction
SELECT h.customer_id,
       CASE WHEN n.customer_id IS NULL THEN health_score ELSE round(greatest(0, health_score - 10)::DECIMAL(28,8), 2)::DOUBLE END AS health_score,
       CASE WHEN n.customer_id IS NULL THEN churn_risk ELSE round(least(1, churn_risk + 0.15::DOUBLE)::DECIMAL(28,8), 4)::DOUBLE END AS churn_risk,
       CASE WHEN n.customer_id IS NULL THEN sentiment_score ELSE round(greatest(0, least(100, round(
         (coalesce(s.total, 0) - n.cnt * 500000)::DOUBLE / 1000000 / (coalesce(s.cnt, 0) + n.cnt), 12) * 25 + 50))::DECIMAL(28,8), 6)::DOUBLE END AS sentiment_score,
       CASE WHEN n.customer_id IS NULL THEN risk_level WHEN churn_risk >= 0.5499 THEN 'CRITICAL' WHEN churn_risk >= 0.2499 THEN 'AT_RISK'
            WHEN churn_risk >= 0.0499 THEN 'MONITOR' ELSE 'HEALTHY' END AS risk_level
FROM o_health h
LEFT JOIN (SELECT customer_id, count(*) AS cnt FROM m_doc WHERE kind = 'NOTE' GROUP BY 1) n ON n.customer_id = h.customer_id
LEFT JOIN (SELECT customer_id, count(*) AS cnt, sum(round(score * 1000000)::BIGINT) AS total FROM t_signal GROUP BY 1) s ON s.customer_id = h.customer_id
-- name: ingest_interaction_scored
, k_note AS (
  SELECT customer_id, count(*) AS n FROM m_doc WHERE kind = 'NOTE' GROUP BY 1
),
k_mood AS (
  SELECT customer_id, round(sum(micro)::DOUBLE / 1000000 / sum(n), 12) AS avg_sentiment
  FROM (SELECT customer_id, sum(round(score * 1000000)::BIGINT) AS micro, count(*) AS n FROM t_signal GROUP BY 1
        UNION ALL SELECT customer_id, n * -500000, n FROM k_note) GROUP BY 1
),
k_fact AS (
  SELECT f.customer_id, m.avg_sentiment, open_claims, denied_claims, avg_resolution, failure_rate,
         CASE WHEN k.n IS NULL THEN days_since_last ELSE least(0, coalesce(days_since_last, 0)) END AS days_since_last, has_churn
  FROM h_fact f LEFT JOIN k_mood m ON m.customer_id = f.customer_id LEFT JOIN k_note k ON k.customer_id = f.customer_id
),
k_part AS (
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
  FROM k_fact
)
SELECT customer_id,
       round((s * 0.25::DOUBLE + c * 0.2::DOUBLE + p * 0.2::DOUBLE + e * 0.15::DOUBLE
              + (1::DOUBLE - churn_pct::DOUBLE / 100) * 100 * 0.2::DOUBLE)::DECIMAL(28,8), 2)::DOUBLE AS health_score,
       churn_pct::DOUBLE / 100 AS churn_risk,
       round(s::DECIMAL(28,8), 2)::DOUBLE AS sentiment_score, round(c::DECIMAL(28,8), 2)::DOUBLE AS claims_score,
       round(p::DECIMAL(28,8), 2)::DOUBLE AS payment_score, round(e::DECIMAL(28,8), 2)::DOUBLE AS engagement_score,
       CASE WHEN churn_pct >= 70 THEN 'CRITICAL' WHEN churn_pct >= 40 THEN 'AT_RISK' WHEN churn_pct >= 20 THEN 'MONITOR' ELSE 'HEALTHY' END AS risk_level,
       '2024-01-31 00:00:00' AS scored_at
FROM k_part
