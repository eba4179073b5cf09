"""Declared schemas. Ids stay strings; nothing is inferred."""

from __future__ import annotations

RECEIVED_TRANSACTION = """
    transaction_id STRING, sender_iban STRING, sender_name STRING, sender_city STRING,
    receiver_iban STRING, receiver_name STRING, receiver_city STRING, amount DOUBLE,
    currency STRING, description STRING, timestamp STRING, received_currency STRING,
    sender_country STRING, receiver_country STRING, payment_type STRING, channel STRING,
    sender_latitude DOUBLE, sender_longitude DOUBLE, sender_ip STRING, device_id STRING,
    fraud_type STRING, ring_id STRING, pattern_label STRING
"""
TRANSACTION_MESSAGE = RECEIVED_TRANSACTION.rstrip() + """,
    schema_version STRING, produced_at STRING, source_system STRING, correlation_id STRING
"""
CANONICAL_TRANSACTION = """
    transaction_id STRING, timestamp STRING, sender_account STRING, receiver_account STRING,
    amount DOUBLE, payment_currency STRING, received_currency STRING, sender_country STRING,
    receiver_country STRING, payment_type STRING
"""
RAW_LABELLED = """
    Time STRING, Date STRING, Sender_account STRING, Receiver_account STRING, Amount DOUBLE,
    Payment_currency STRING, Received_currency STRING, Sender_bank_location STRING,
    Receiver_bank_location STRING, Payment_type STRING, Is_laundering TINYINT,
    Laundering_type STRING
"""
CANONICAL_COLUMNS = (
    "transaction_id", "timestamp", "sender_account", "receiver_account", "amount",
    "payment_currency", "received_currency", "sender_country", "receiver_country",
    "payment_type",
)
DATASET_COLUMNS = CANONICAL_COLUMNS + (
    "is_laundering", "laundering_type", "sender_iban", "sender_name", "receiver_iban",
    "receiver_name",
)
EVIDENCE_ITEM = """
    STRUCT<detector_type: STRING, detector_version: STRING, confidence: DOUBLE,
           contribution: DOUBLE, summary: STRING, details: STRING>
"""
ALERT = f"""
    alert_id STRING, fraud_type STRING, severity STRING, confidence DOUBLE,
    transaction_id STRING, sender_iban STRING, sender_name STRING, sender_city STRING,
    receiver_iban STRING, receiver_name STRING, receiver_city STRING, amount DOUBLE,
    currency STRING, title STRING, description STRING, evidence ARRAY<{EVIDENCE_ITEM}>,
    related_transactions ARRAY<STRING>, related_accounts ARRAY<STRING>, case_id STRING,
    detected_at TIMESTAMP, is_dismissed BOOLEAN
"""
