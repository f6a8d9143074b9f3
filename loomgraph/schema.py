"""The property graph's tables, and the values that they may hold."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

# The labels, edge types and provenance tags that a graph may have.
LABELS = (
    "Customer", "Company", "Contact", "Product", "Deal", "Ticket", "Issue", "Agent", "Channel", "Article", "Topic", "Keyword",
    "Campaign", "Audience", "Interaction", "Proposal", "Feedback", "Lead", "Opportunity", "Contract", "Service", "Department",
    "Event", "Document", "Note", "Tag", "Person", "Organization",
    "Project", "Module", "Config", "Folder", "File",
    "Function", "Class", "Import", "Variable", "Decorator",
)
EDGE_TYPES = (
    "works_at", "bought", "interested_in", "contacted_via", "opened_ticket", "complained_about", "resolved_by", "mentioned_in",
    "about", "targets", "published_in", "links_to", "proposed_to", "signed", "renewed", "churned", "referred_by", "manages",
    "belongs_to", "part_of", "related_to", "converted_to", "assigned_to", "escalated_to", "responded_to", "follows_up",
    "authored", "reviewed", "approved", "attended", "registered_for",
    "CONTAINS", "USES", "DOCUMENTS", "IMPLEMENTS", "TESTS", "DEFINES", "EXPOSES_MCP", "CONFIGURES", "RUNS", "MONITORS",
    "INTEGRATES_WITH", "DEPENDS_ON", "IMPORTS", "CALLS", "HAS_MODULE",
    "DEFINES_FUNC", "DEFINES_CLASS", "DECORATES", "INHERITS_FROM", "IMPORTS_FROM", "CALLS_FUNC", "READS_VAR", "WRITES_VAR",
)
PROVENANCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
# Keys of properties whose values are personal.
PII_KEYS = ("email", "phone", "cpf", "cnpj", "password", "token", "secret", "api_key", "credit_card")
# Limits on input.
NAME_CHARS, PROPERTY_CHARS, BATCH_ITEMS, QUERY_CHARS, QUERY_ROWS = 512, 65_536, 10_000, 10_000, 10_000



def struct(columns: str) -> StructType:
    """`name type, ...` as a schema; needs no session."""
    types = {"long": LongType(), "string": StringType(), "double": DoubleType(), "timestamp": TimestampType(), "int": IntegerType(), "boolean": BooleanType()}
    return StructType([StructField(name, types[kind]) for name, kind in (c.split() for c in columns.split(", "))])


NODES = struct("id long, label string, name string, qualified_name string, properties string, provenance string, source string, created_at timestamp, updated_at timestamp")
EDGES = struct("id long, source_id long, target_id long, type string, properties string, provenance string, weight double, created_at timestamp")
COMMUNITIES = struct("node_id long, community_id long, algorithm string, created_at timestamp")
METADATA = struct("key string, value string, updated_at timestamp")
AUDIT = struct("event string, entity_type string, entity_id long, label string, qualified_name string, source string, timestamp timestamp")
SPANS = struct(
    "id long, trace_id string, span_id string, parent_id string, tool string, duration_ms double, error string, args_summary string, result_size long, timestamp timestamp, agent_id string, cost_usd double, checkpoint string"
)
TABLES = {"nodes": NODES, "edges": EDGES, "communities": COMMUNITIES, "metadata": METADATA, "audit_log": AUDIT, "telemetry_spans": SPANS}
