"""Bounded value pools of the span model.

FIXED VALUES: these must equal the generator's pools so that names,
attributes and cardinalities match. They are listed plainly, in their
natural order; picks index them with a keyed hash draw.
"""

# --- fixed values -----------------------------------------------------------
SERVICE_NAMES = [
    "frontend", "api-gateway", "checkout", "cart", "catalog", "payment",
    "shipping", "inventory", "user", "auth", "recommendation", "search",
    "pricing", "promotion", "order", "notification", "email", "fraud",
    "analytics", "loyalty", "wishlist", "review", "media", "session",
]

HTTP_ROUTES = [  # (method, route)
    ("GET", "/api/products"), ("GET", "/api/products/{id}"), ("POST", "/api/cart"),
    ("GET", "/api/cart"), ("POST", "/api/checkout"), ("POST", "/api/orders"),
    ("GET", "/api/orders/{id}"), ("POST", "/api/payments"), ("GET", "/api/users/{id}"),
    ("POST", "/api/login"), ("GET", "/api/search"), ("POST", "/api/recommendations"),
]

DB_SYSTEMS = [  # (system, operation, collection)
    ("postgresql", "SELECT", "orders"), ("postgresql", "INSERT", "orders"),
    ("postgresql", "SELECT", "products"), ("mysql", "SELECT", "users"),
    ("redis", "GET", "session"), ("redis", "SETEX", "cart"),
    ("mongodb", "find", "catalog"), ("cassandra", "SELECT", "events"),
]

DB_PORTS = {"postgresql": 5432, "mysql": 3306, "redis": 6379, "mongodb": 27017, "cassandra": 9042}

ENVIRONMENTS = ["production", "staging"]
REGIONS = ["us-east-1", "us-west-2", "eu-central-1"]

EXCEPTION_TYPES = [
    "java.lang.RuntimeException", "context.DeadlineExceeded", "sql.ErrNoRows",
    "net.OpError", "ValidationError",
]
INFO_STAGES = ["validate", "enrich", "persist", "publish", "respond"]
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15)",
    "curl/8.4.0", "okhttp/4.12.0", "Go-http-client/2.0", "PostmanRuntime/7.36.0",
]
HTTP_STATUS_OK = [200, 200, 200, 201, 204, 304]
HTTP_STATUS_ERROR = [500, 502, 503, 504, 400, 404]
GRPC_STATUS_ERROR = [2, 4, 13, 14]  # UNKNOWN, DEADLINE_EXCEEDED, INTERNAL, UNAVAILABLE

# Log-normal latency parameters (ln of nanoseconds) per operation family.
LATENCY_PARAMS = {
    "http_server": (16.0, 0.6),
    "msg_consumer": (15.5, 0.7),
    "http_client": (15.0, 0.7),
    "rpc_client": (14.5, 0.7),
    "db_client": (13.5, 0.8),
    "internal": (13.0, 0.9),
}

SCOPE_NAME = "spans"
SCOPE_VERSION = "1.0.0"
NAMESPACE = "shop"
ERROR_RATE = 0.015
EVENT_RATE = 0.10
SERVICE_HOST_SUFFIX = ".shop.svc.cluster.local"
PEER_HOST = "svc.shop.svc.cluster.local"
STATUS_MESSAGE_ERROR = "operation failed"
EXCEPTION_MESSAGE = "request processing failed"
SDK_VERSION = "1.31.0"
# Upper bounds (seconds) of the send-latency histogram (13 bounds).
LATENCY_BUCKETS = [0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]
# --- end of fixed values ----------------------------------------------------
