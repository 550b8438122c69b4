"""Record types and the fixed values the data contract allows."""

from __future__ import annotations

from pyspark.sql import types as T

# Enum members, defaults and limits of the data contract.
SENDERS = ("customer", "agent", "system")
CHANNELS = ("chat", "email", "voice", "sms")
SENTIMENTS = ("positive", "neutral", "negative")
EMOTIONS = ("angry", "frustrated", "satisfied", "confused", "urgent", "happy", "neutral")
PII_TYPES = ("email", "phone", "credit_card", "ssn", "address", "account_number", "name")
INTENTS = ("Refund Request", "Technical Issue", "Billing Inquiry", "Feature Request",
           "Complaint", "General Inquiry", "Account Issue", "Cancellation")
URGENCIES = ("Low", "Medium", "High", "Critical")
DEFAULT_TENANT = "demo-tenant"
DEFAULT_CHANNEL = "chat"
REDACTED = "[REDACTED]"
MAX_MESSAGE_CHARS = 10_000
WINDOW_MESSAGES = 10
CONTEXT_MESSAGES = 5
RETENTION_SECONDS = 300
REQUESTS_PER_MINUTE = 1000
TOPIC_MESSAGES = "support.messages.raw"
TOPIC_STATE = "support.conversations.state"
TOPIC_SENTIMENT = "support.ai.sentiment"
TOPIC_PII = "support.ai.pii"
TOPIC_INSIGHTS = "support.ai.insights"
TOPIC_SUMMARY = "support.ai.summary"
TOPIC_AGGREGATED = "support.ai.aggregated"
TOPIC_DLQ = "support.dlq"

KEYS = ("tenant_id", "conversation_id")
KINDS = ("sentiment", "pii", "insights", "summary")
# Kind of a result from the two fields that must be present, first match wins.
KIND_FIELDS = (("sentiment", "sentiment", "emotion"), ("pii", "has_pii", "entities"),
               ("insights", "intent", "urgency"), ("summary", "tldr", "customer_issue"))

TEXT, FLAG, INT, LONG = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()
TIME = T.TimestampNTZType()
TEXTS = T.ArrayType(T.StringType())
METADATA = T.MapType(T.StringType(), T.StringType())


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


REQUEST = record(conversation_id=TEXT, sender=TEXT, message=TEXT, channel=TEXT, tenant_id=TEXT,
                 metadata=METADATA)
MESSAGE = record(message_id=TEXT, conversation_id=TEXT, tenant_id=TEXT, sender=TEXT,
                 message=TEXT, channel=TEXT, timestamp=TIME, metadata=METADATA)
# An element of the rolling window; the two keys stand on the row itself.
WINDOW_MESSAGE = record(message_id=TEXT, sender=TEXT, message=TEXT, channel=TEXT,
                        timestamp=TIME, metadata=METADATA)
ENTITY = record(type=TEXT, value=TEXT, start_index=INT, end_index=INT)
SENTIMENT = record(sentiment=TEXT, confidence=T.DoubleType(), emotion=TEXT, reasoning=TEXT,
                   timestamp=TIME)
PII = record(has_pii=FLAG, entities=T.ArrayType(ENTITY), redacted_text=TEXT, timestamp=TIME)
INSIGHTS = record(intent=TEXT, urgency=TEXT, categories=TEXTS, suggested_actions=TEXTS,
                  requires_escalation=FLAG, estimated_resolution_time=TEXT, key_concerns=TEXTS,
                  timestamp=TIME)
SUMMARY = record(tldr=TEXT, customer_issue=TEXT, agent_response=TEXT, key_points=TEXTS,
                 next_steps=TEXTS, timestamp=TIME)
SUMMARY_STREAM = record(conversation_id=TEXT, tenant_id=TEXT, tldr=TEXT, customer_issue=TEXT,
                        agent_response=TEXT, key_points=TEXTS, next_steps=TEXTS)
PAYLOADS = {"sentiment": SENTIMENT, "pii": PII, "insights": INSIGHTS, "summary": SUMMARY}
# A row of a topic as the broker connector delivers it, value and key as text.
ENVELOPE = record(topic=TEXT, partition=INT, offset=LONG, key=TEXT, value=TEXT,
                  headers=T.ArrayType(record(key=TEXT, value=T.BinaryType())), timestamp=TIME)
