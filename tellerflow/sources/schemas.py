"""Fixed schemas; no source is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "str": T.StringType(),
    "date": T.DateType(),
    "time": T.TimestampNTZType(),
    "money": MONEY,
    "rate": T.DecimalType(5, 2),
    "double": T.DoubleType(),
}


def _schema(columns: str) -> T.StructType:
    """'name:type name:type' as a struct type."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split(":") for c in columns.split())])


BULK = {
    "user_details": _schema(
        "user_id:long name:str email:str phone:str address:str date_of_birth:date occupation:str annual_income:long"
    ),
    "transaction_details": _schema(
        "transaction_id:long user_id:long type:str amount:money timestamp:time status:str description:str"
    ),
    "credit_cards": _schema(
        "card_id:long user_id:long card_type:str card_number:str expiry_date:str credit_limit:long"
        " current_balance:money status:str"
    ),
    "loans": _schema(
        "loan_id:long user_id:long loan_type:str amount:money interest_rate:rate term_months:int status:str"
        " application_date:time"
    ),
    "complaints": _schema(
        "complaint_id:long user_id:long type:str description:str priority:str status:str created_at:time"
        " resolved_at:time"
    ),
    "fraud_reports": _schema(
        "report_id:long user_id:long fraud_type:str description:str amount_involved:money reported_date:time status:str"
    ),
    "faqs": _schema("question_id:long question:str answer:str category:str"),
    "assistance": _schema(
        "assistance_id:long user_id:long type:str query:str status:str created_at:time response_time:int"
    ),
}

USERS = _schema("id:long username:str created_at:time")
CHAT_HISTORY = _schema(
    "id:long user_id:long message:str response:str intent:str confidence:double timestamp:time"
)
CORPUS = _schema("text:str response:str intent:str")
SUMMARY = _schema("intent:str count:long sample_response:str")
ACCOUNTS = _schema("user_id:long account_type:str account_number:str balance:money")
LEDGER = _schema("user_id:long account_type:str pos:long date:str description:str amount:money id:str")
MESSAGES = _schema("event_id:long user_id:long ts:time message:str")

INTENTS = T.StructType(
    [
        T.StructField(
            "intents",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("tag", T.StringType()),
                        T.StructField("patterns", T.ArrayType(T.StringType())),
                        T.StructField("responses", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        )
    ]
)
TEMPLATES = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
