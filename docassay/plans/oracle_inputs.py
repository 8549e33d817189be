"""The adapters of ``docassay.sources.adapters`` again, as SQL for the checking engine. Money is in paise."""

from __future__ import annotations

_L = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (({}) % 26)::INT + 1, 1)"


def letter(e: str) -> str:
    return _L.format(e)


# Product and permutation tables of the checksum, flattened by rule in functions.identity.
def _checksum_tables() -> str:
    from docassay.functions.identity import _TABLES

    return (
        f"vtab AS (SELECT {_TABLES['mul']} AS mul, {_TABLES['perm']} AS perm, {_TABLES['inv']} AS inv)"
    )


def _digit(expr: str, shift: int) -> str:
    """Checksum fold over a digit string."""
    return (
        f"list_reduce(list_prepend(0, list_transform(generate_series(0, length({expr})-1), lambda i: "
        f"perm[(((i + {shift}) % 8) * 10 + substr({expr}, (length({expr}) - i)::INT, 1)::INT)::INT + 1])), "
        f"lambda a, p: mul[(a * 10 + p)::INT + 1])"
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (deps, sql)


cte("vtab", _checksum_tables().split(" AS (", 1)[1][:-1])

cte(
    "ledger",
    """
    SELECT 'S' || acct AS doc_id, acct, okey, pos - 1 AS idx,
      CASE WHEN okey % 101 = 7 THEN day - 40 ELSE day END AS posted,
      credit_p, debit_p,
      CASE WHEN okey % 13 = 6 THEN NULL WHEN okey % 23 = 9 THEN 100
           WHEN okey % 62 = 4 THEN opening_p + moved - 2 * (coalesce(credit_p, 0) - coalesce(debit_p, 0))
           WHEN acct % 7 = 3 AND pos = 3 THEN opening_p + moved + 100000 ELSE opening_p + moved END AS balance_p,
      opening_p,
      CASE priority WHEN '1-URGENT' THEN 'NEFT SALARY CREDIT' WHEN '2-HIGH' THEN 'IMPS/SAL/ACME'
        ELSE 'UPI WHOLESALE' END AS narration,
      okey % 17 <> 4 AS move_agree, okey % 11 <> 5 AS bal_agree,
      CASE WHEN okey % 19 = 7 THEN 0.5 ELSE 0.9 END::DOUBLE AS conf,
      CASE WHEN okey % 31 = 4 THEN NULL
           WHEN (credit_p IS NOT NULL) <> (okey % 29 = 3) THEN 850.0 + okey % 5 ELSE 700.0 + okey % 5 END::DOUBLE AS x
    FROM (
      SELECT o_custkey AS acct, o_orderkey AS okey, o_orderpriority AS priority, o_orderdate::DATE AS day,
        CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS credit_p,
        CASE WHEN o_orderstatus <> 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS debit_p,
        CAST(round(c_acctbal * 100) AS BIGINT) AS opening_p,
        (sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT))
          OVER w)::BIGINT AS moved,
        row_number() OVER w AS pos
      FROM orders JOIN customer ON o_custkey = c_custkey
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey))
    """,
)
cte(
    "summary",
    """
    SELECT doc_id, acct, opening_p,
      opening_p + cr - dr + CASE WHEN acct % 13 = 4 THEN 50000 ELSE 0 END AS closing_p,
      dr AS total_debits_p, cr + CASE WHEN acct % 13 = 5 THEN 25000 ELSE 0 END AS total_credits_p,
      period_start, period_end, acct % 19 <> 3 AS closing_ok
    FROM (SELECT doc_id, acct, max(opening_p) AS opening_p, coalesce(sum(debit_p), 0)::BIGINT AS dr,
            coalesce(sum(credit_p), 0)::BIGINT AS cr, min(posted) AS period_start, max(posted) AS period_end
          FROM ledger GROUP BY 1, 2)
    """,
    "ledger",
)
# Trusted view of the ledger: untrusted figures become null.
cte(
    "trusted",
    """
    SELECT doc_id, acct, okey, idx, opening_p,
      CASE WHEN conf >= 0.55 AND move_agree THEN credit_p END AS cr,
      CASE WHEN conf >= 0.55 AND move_agree THEN debit_p END AS dr,
      CASE WHEN conf >= 0.55 AND bal_agree THEN balance_p END AS bal,
      CASE WHEN conf >= 0.55 THEN posted END AS day,
      CASE WHEN conf >= 0.55 THEN narration END AS narration_t,
      narration, posted, balance_p, credit_p, debit_p, x, conf,
      NOT (conf >= 0.55 AND move_agree) AS move_untrusted
    FROM ledger
    """,
    "ledger",
)
# Re-anchored running balance over the trusted rows.
cte(
    "chain",
    """
    SELECT *, abs(expected - bal) > 100 AS broken FROM (
      SELECT *, coalesce(last_anchor[1], opening_p - 0) +
          cum - coalesce(last_anchor[2], 0) AS expected,
        pos - 1 - coalesce(last_anchor[3], 0) AS unread
      FROM (
        SELECT *, last_value(CASE WHEN bal IS NOT NULL THEN [bal, cum, pos] END IGNORE NULLS) OVER
            (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_anchor
        FROM (SELECT *, (sum(coalesce(cr, 0) - coalesce(dr, 0)) OVER (PARTITION BY doc_id ORDER BY idx))::BIGINT AS cum,
                row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos FROM trusted)))
    """,
    "trusted",
)
cte(
    "chain_ok",
    """
    SELECT doc_id, count(bal) >= 2 AND count_if(cr IS NOT NULL OR dr IS NOT NULL) >= 1 AS evaluated
    FROM trusted GROUP BY 1
    """,
    "trusted",
)
cte(
    "income",
    """
    SELECT k AS cust, base_p + 5000000 AS gross_p, base_p // 10 + 100000 AS deductions_p,
      net + CASE WHEN k % 11 = 4 THEN 500000 ELSE 0 END AS net_p,
      CASE WHEN k % 9 = 2 THEN net * 6 ELSE net * 12 + 6000000 END AS annual_gross_p,
      net * 12 + CASE WHEN k % 10 = 3 THEN 7000000 ELSE -1000000 END AS taxable_p,
      seg || ' MILLS PVT LTD' AS employer,
      CASE WHEN k % 8 = 5 THEN 'NORTHWIND TRADERS' WHEN k % 8 = 6 THEN seg || ' MILS LIMITED'
        ELSE seg || ' Mills Private Limited' END AS employer_proof, k % 23 <> 5 AS taxable_ok
    FROM (SELECT c_custkey AS k, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS base_p, c_mktsegment AS seg,
            abs(CAST(round(c_acctbal * 100) AS BIGINT)) + 5000000
              - abs(CAST(round(c_acctbal * 100) AS BIGINT)) // 10 - 100000 AS net FROM customer)
    """,
)
cte(
    "claims",
    """
    SELECT doc_id, 'BANK_STATEMENT' AS doc_type, 'transaction_' || idx AS subject, pred AS predicate, val AS value,
      idx AS index, idx * 8 + n AS ord, crit AS cross_read_required, agree, conf AS confidence
    FROM (
      SELECT doc_id, idx, conf, unnest([
        {'pred': 'posted_on', 'val': strftime(posted, '%d/%m/%Y'), 'crit': false, 'agree': false, 'n': 0},
        {'pred': 'description', 'val': narration, 'crit': false, 'agree': false, 'n': 1},
        {'pred': 'debit', 'val': printf('%.2f', debit_p / 100.0), 'crit': true, 'agree': move_agree, 'n': 2},
        {'pred': 'credit', 'val': printf('%.2f', credit_p / 100.0), 'crit': true, 'agree': move_agree, 'n': 3},
        {'pred': 'running_balance', 'val': printf('%.2f', balance_p / 100.0), 'crit': true, 'agree': bal_agree, 'n': 4}
      ], recursive := true) FROM ledger) WHERE val IS NOT NULL
    UNION ALL
    SELECT doc_id, 'BANK_STATEMENT', 'account', pred, val, NULL, n, crit, agree, 0.9 FROM (
      SELECT doc_id, unnest([
        {'pred': 'opening_balance', 'val': printf('%.2f', opening_p / 100.0), 'crit': true, 'agree': true, 'n': -6},
        {'pred': 'closing_balance', 'val': printf('%.2f', closing_p / 100.0), 'crit': true, 'agree': closing_ok, 'n': -5},
        {'pred': 'total_debits', 'val': printf('%.2f', total_debits_p / 100.0), 'crit': true, 'agree': true, 'n': -4},
        {'pred': 'total_credits', 'val': printf('%.2f', total_credits_p / 100.0), 'crit': true, 'agree': true, 'n': -3},
        {'pred': 'period_start', 'val': strftime(period_start, '%Y-%m-%d'), 'crit': false, 'agree': true, 'n': -2},
        {'pred': 'period_end', 'val': strftime(period_end, '%Y-%m-%d'), 'crit': false, 'agree': true, 'n': -1}
      ], recursive := true) FROM summary)
    UNION ALL
    SELECT 'P' || cust, 'SALARY_SLIP', 'salary_slip', pred, val, NULL, n, crit, true, 0.9 FROM (
      SELECT cust, unnest([
        {'pred': 'gross_earnings', 'val': printf('%.2f', gross_p / 100.0), 'crit': true, 'n': 0},
        {'pred': 'total_deductions', 'val': printf('%.2f', deductions_p / 100.0), 'crit': true, 'n': 1},
        {'pred': 'net_pay', 'val': printf('%.2f', net_p / 100.0), 'crit': true, 'n': 2},
        {'pred': 'employer', 'val': employer, 'crit': false, 'n': 3}], recursive := true) FROM income)
    UNION ALL
    SELECT 'I' || cust, 'FORM16', 'income_proof', pred, val, NULL, n, crit, agree, 0.9 FROM (
      SELECT cust, unnest([
        {'pred': 'gross_income', 'val': printf('%.2f', annual_gross_p / 100.0), 'crit': true, 'agree': true, 'n': 0},
        {'pred': 'taxable_income', 'val': printf('%.2f', taxable_p / 100.0), 'crit': true, 'agree': taxable_ok, 'n': 1},
        {'pred': 'employer', 'val': employer_proof, 'crit': false, 'agree': true, 'n': 2}], recursive := true)
      FROM income)
    """,
    "ledger", "summary", "income",
)
_PAN = (
    f"{letter('k')} || {letter('k // 26')} || {letter('k // 676')} || 'P' || {letter('k // 7')} || "
    f"lpad((k % 10000)::VARCHAR, 4, '0') || {letter('k // 3')}"
)
cte(
    "entities",
    f"""
    SELECT k AS bundle_id, d AS ord,
      ['statement', 'payslip', 'pan_card', 'aadhaar_card'][d + 1] AS doc_label,
      CASE WHEN k % 17 = 2 AND d = 1 THEN substr(pan0, 1, 9) || '#' WHEN k % 17 = 5 AND d = 2 THEN 'ZZZPZ9999Z'
        ELSE pan0 END AS pan,
      CASE WHEN d < 2 THEN NULL WHEN k % 19 = 4 AND d = 3 THEN '300000000000' ELSE aad0 END AS aadhaar,
      CASE WHEN d = 0 THEN ifsc0 WHEN d = 1 AND k % 29 <> 6 THEN ifsc0 WHEN d = 1 THEN 'SBIN0999999' END AS ifsc,
      CASE WHEN d <= 1 THEN lpad((k * 7 + 100000000)::VARCHAR, 12, '0') END AS account_number,
      CASE WHEN k % 23 = 7 AND d = 3 THEN 'ANIL KUMAR VERMA' WHEN d = 1 THEN 'R ' || {letter('k')} || ' SHARMA'
        WHEN d = 2 AND k % 5 = 1 THEN 'RAVI ' || {letter('k')} || 'UMAR SHARMAA'
        ELSE 'RAVI ' || {letter('k')} || 'UMAR SHARMA' END AS name,
      CASE WHEN d >= 2 THEN (1960 + k % 40) || '-0' || (1 + k % 9) || '-1' || (k % 10) END AS dob
    FROM (
      SELECT k, d, {_PAN} AS pan0,
        eleven || inv[{_digit('eleven', 1)} + 1] AS aad0,
        ['SBIN', 'HDFC', 'ICIC', 'UTIB', 'CNRB', 'PUNB', 'KKBK'][(nation % 7 + 1)::INT] || '0'
          || lpad((k % 1000000)::VARCHAR, 6, '0') AS ifsc0
      FROM (SELECT c_custkey AS k, c_nationkey AS nation, '3' || lpad(c_custkey::VARCHAR, 10, '0') AS eleven
            FROM customer), vtab, (SELECT unnest([0, 1, 2, 3]) AS d))
    """,
    "vtab",
)
cte(
    "kyc_text",
    """
    SELECT doc_label || '-' || k AS doc_id, k AS bundle_id,
      CASE k % 4 WHEN 1 THEN 'Statement of Account\nCanara Bank and HDFC Bank\n'
        WHEN 2 THEN 'Opening balance and closing balance\n' WHEN 3 THEN 'Salary slip net pay for axis\n'
        ELSE 'Permanent Account Number\n' END
      || 'Customer Name: Mr. ' || array_to_string(list_transform(string_split(name, ' '),
           lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || '\nPAN ' || pan || '\n'
      || CASE WHEN aadhaar IS NULL THEN '' WHEN k % 3 = 0 THEN 'Aadhaar No: ' || aadhaar || '\n'
           WHEN k % 3 = 1 THEN 'ID ' || substr(aadhaar, 1, 4) || ' ' || substr(aadhaar, 5, 4) || ' '
             || substr(aadhaar, 9, 4) || '\n'
           ELSE 'Reference ' || aadhaar || '\n' END
      || CASE WHEN dob IS NULL THEN '' ELSE 'Date of Birth: ' || CASE WHEN k % 2 = 0
           THEN strftime(dob::DATE, '%d/%m/%Y') ELSE dob END || '\n' END
      || CASE WHEN account_number IS NULL THEN '' ELSE 'A/c No: ' || account_number || '\n' END
      || CASE WHEN ifsc IS NULL OR k % 4 = 1 THEN '' ELSE 'IFSC ' || ifsc || '\n' END AS text
    FROM (SELECT *, bundle_id AS k FROM entities)
    """.replace("\\n", "' || chr(10) || '"),
    "entities",
)
cte(
    "applications",
    """
    SELECT 'C' || lpad(k::VARCHAR, 12, '0') AS case_id, 'bank' || nation AS bank_id, kind, val AS value FROM (
      SELECT k, nation, unnest([
        {'kind': 'payout_account', 'val': CASE WHEN k % 20 < 5 THEN '77-' || lpad((k // 20)::VARCHAR, 8, '0')
           ELSE '88-' || lpad(k::VARCHAR, 8, '0') END},
        {'kind': 'device', 'val': CASE WHEN k % 20 BETWEEN 4 AND 8 THEN 'dev g' || (k // 20) ELSE 'dev  ' || k END},
        {'kind': 'employer', 'val': CASE WHEN k % 20 BETWEEN 12 AND 15 THEN 'emp g' || (k // 20) ELSE 'emp ' || k END},
        {'kind': 'phone', 'val': '+91 9' || lpad(k::VARCHAR, 9, '0')}], recursive := true)
      FROM (SELECT c_custkey AS k, c_nationkey AS nation FROM customer))
    """,
)


def _words(hexcol: str) -> str:
    return ", ".join(f"('0x' || substr({hexcol}, {i * 8 + 1}, 8))::BIGINT AS w{i}" for i in range(8))


cte(
    "fraud_store",
    f"""
    SELECT entry_id, label, w0, w1, w2, w3, w4, w5, w6, xor(w7, (pow(2, (entry_id % 5) * 3) - 1)::BIGINT) AS w7
    FROM (SELECT doc_id AS entry_id, source AS label, {_words("sha256((doc_id // 5)::VARCHAR)")} FROM documents)
    """,
)
cte(
    "query_hashes",
    f"""
    SELECT query_id, xor(w0, (pow(2, bits) - 1)::BIGINT) AS w0, w1, w2, w3, w4, w5, w6, w7
    FROM (SELECT doc_id AS query_id, quality * 2 + toxic AS bits, {_words("sha256((doc_id // 5)::VARCHAR)")} FROM labels)
    """,
)
cte(
    "words",
    """
    SELECT doc_id, 0 AS page, 0 AS block, line, pos, text, pos * 60 AS left, line * 20 + CASE WHEN k % 97 = 0 THEN 9
        ELSE k % 2 END AS top, length(text) * 8 AS width, CASE WHEN k % 89 = 5 THEN 22 ELSE 12 END AS height,
      CASE WHEN k % 83 = 2 THEN 0.2 ELSE 0.1 END::DOUBLE AS stroke, (30 + k % 70) / 100.0 AS conf
    FROM (SELECT doc_id, line, pos, text, doc_id + line + pos AS k FROM (
      SELECT doc_id, line, unnest(string_split(t, ' ')) AS text, generate_subscripts(string_split(t, ' '), 1) - 1 AS pos
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
              generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents))) WHERE text <> ''
    """,
)
cte(
    "deeds",
    f"""
    SELECT l_orderkey * 8 + l_linenumber AS deed_id, l_partkey AS parcel, l_suppkey AS applicant,
      l_shipdate::DATE AS executed, CAST(round(l_extendedprice * 100) AS BIGINT) AS consideration_p,
      l_quantity::INT AS qty, round(l_tax * 100)::INT AS tax_pct, round(l_discount * 100)::INT AS disc_pct,
      'ASHA ' || {letter("CASE WHEN l_orderkey % 5 = 0 THEN l_partkey % 7 + 1 ELSE l_partkey % 7 END")} || 'OWNER' AS seller,
      'ASHA ' || {letter("l_partkey % 7")} || 'OWNER' AS buyer,
      l_shipdate::DATE + CASE WHEN l_orderkey % 9 = 4 THEN 200 ELSE 30 END AS registered
    FROM lineitem
    """,
)
cte(
    "labelled_cases",
    """
    SELECT l.doc_id AS case_no, n_chars::DOUBLE AS n_chars, toxic::DOUBLE AS toxic, lang, source, quality = 0 AS is_fraud
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id
    """,
)
cte(
    "audit_events",
    """
    SELECT 'u' || user_id AS chain_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
      '{"event":' || event_id || ',"kind":"' || event_type || '"}' AS payload FROM events
    """,
)
cte(
    "signals",
    """
    SELECT doc_id, n AS ord, ['financial_consistency', 'cross_document_consistency', 'font_layout', 'anomaly_intelligence',
        'signature', 'pdf_only_red_flag', 'phash_resubmission'][n] AS name,
      CASE WHEN n IN (5, 6) THEN 1 ELSE 3 END AS layer, status,
      CASE WHEN status = 'VALID' THEN CASE WHEN n = 2 THEN CASE WHEN doc_id % 4 = 0 THEN 0.4 ELSE 0.04 END
        WHEN doc_id % 3 = 0 THEN round(l_discount * 4, 2) ELSE 0.0 END END::DOUBLE AS suspicion,
      [0.40, 0.50, 0.10, 0.10, 0.0, 0.10, 0.15][n]::DOUBLE AS weight,
      n = 7 AND doc_id % 41 = 3 AS hard_reject, n = 4 AS review_only,
      CASE WHEN n = 5 THEN CASE WHEN doc_id % 31 = 5 THEN 'tampered' WHEN doc_id % 7 = 2 THEN 'verified'
        ELSE 'absent' END END AS provenance,
      CASE WHEN n = 6 AND doc_id % 5 = 1 THEN 'pdf_only_when_pullable' END AS red_flag
    FROM (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_discount,
            CASE WHEN (l_orderkey + l_linenumber) % 37 = 1 THEN 'ERROR'
                 WHEN (l_orderkey + l_linenumber * 3) % 6 = 1 THEN 'NOT_EVALUATED' ELSE 'VALID' END AS status
          FROM lineitem)
    """,
)



_UNITS = ("['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen',"
          "'fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']")
cte(
    "agreements",
    f"""
    SELECT 'A' || k AS doc_id, k, applicant, effective, (whole + CASE WHEN k % 12 = 5 THEN 1000 ELSE 0 END) * 100 AS consideration_p,
      whole, k % 25 = 3 AS unreadable, CASE WHEN k % 6 = 1 THEN 50 ELSE 0 END AS paise,
      'Rupees ' || {_UNITS}[a + 1] || ' lakh ' || {_UNITS}[b + 1] || ' thousand ' || {_UNITS}[c + 1]
        || CASE WHEN k % 25 = 3 THEN ' zillion and ' ELSE ' hundred and ' END
        || ['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'][t + 1]
        || CASE WHEN k % 6 = 1 THEN ' and fifty paise only' ELSE ' only' END AS words,
      term, (effective + to_months(term::INT))::DATE + CASE WHEN k % 14 = 3 THEN 5 ELSE 0 END AS end_date,
      (effective + to_months(term::INT))::DATE AS due_date,
      k % 4 + 2 AS pages, 9 + k % 5 AS rate, whole * 100 AS principal_p,
      round(whole * (9 + k % 5) / 1200.0 * pow(1 + (9 + k % 5) / 1200.0, term)
        / (pow(1 + (9 + k % 5) / 1200.0, term) - 1), 2) AS emi_true,
      CASE WHEN k % 13 = 6 THEN 100 ELSE 0 END AS emi_shift
    FROM (SELECT *, a * 100000 + b * 1000 + c * 100 + (t + 2) * 10 AS whole FROM (
      SELECT o_orderkey AS k, o_custkey AS applicant, o_orderdate::DATE AS effective, o_orderkey % 19 + 1 AS a,
        (o_orderkey // 19) % 19 + 1 AS b, (o_orderkey // 7) % 9 + 1 AS c, (o_orderkey // 3) % 8 AS t,
        o_orderkey % 36 + 1 AS term FROM orders))
    """,
)
cte(
    "land",
    f"""
    SELECT p_partkey AS bundle_id, p_partkey AS k, 'ASHA ' || {letter('p_partkey')} || 'OWNER' AS seller,
      CASE WHEN p_partkey % 9 = 4 THEN 'KIRAN DOSHI' WHEN p_partkey % 9 = 5 THEN 'A ' || {letter('p_partkey')} || 'OWNERS'
        ELSE 'ASHA ' || {letter('p_partkey')} || 'OWNER' END AS owner,
      p_size * 100.0::DOUBLE AS deed_extent,
      (p_size * 100.0::DOUBLE / f + CASE WHEN p_partkey % 8 = 3 THEN 40 ELSE 0 END) * f AS record_sqm,
      p_partkey % 5 <> 4 AS unit_known, price_p * 1000 AS consideration_p,
      CASE WHEN p_partkey % 4 = 1 THEN price_p * 1500 ELSE price_p * 700 END AS guidance_p,
      CASE WHEN p_partkey % 7 = 2 THEN price_p * 30
        ELSE price_p * CASE WHEN p_partkey % 4 = 1 THEN 1500 ELSE 1000 END * (4 + p_partkey % 6) // 100 END AS duty_p,
      CASE WHEN p_partkey % 30 < 25 THEN 4 + p_partkey % 6 END AS rate_pct,
      price_p * 1000 + CASE WHEN p_partkey % 14 = 3 THEN 5000 ELSE 0 END AS agreement_p,
      CASE WHEN p_partkey % 15 = 8 THEN price_p * 999 ELSE price_p * 1000 END AS paid_p
    FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS price_p,
            [1.0, 0.092903, 4046.8564, 40.4686, 1.0][(p_partkey % 5 + 1)::INT]::DOUBLE AS f FROM part)
    """,
)


def compose(uses: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the CTEs it uses, dependencies first."""
    done: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in done:
            done.append(name)

    for u in uses:
        visit(u)
    body = body.strip()
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
