"""Column types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
QUANTITY = T.DecimalType(12, 3)
# Extracted amounts are checked for range only later, so they get more room.
AMOUNT = T.DecimalType(20, 2)

JOB_STATES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
DOCUMENT_STATES = ("RECEIVED", "PROCESSING", "PROCESSED", "FAILED")

# Payload as recovered from a JSON reply: every scalar is text, the contract
# check decides what it may become.
PAYLOAD_DDL = (
    "number string, date string, issue_date string, due_date string, currency string, "
    "subtotal string, tax string, total string, "
    "supplier struct<name:string,tax_id:string,address:string,phone:string,email:string>, "
    "items array<struct<description:string,quantity:string,unit_price:string,"
    "tax:string,total:string>>"
)
