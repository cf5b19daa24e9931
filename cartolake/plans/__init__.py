from cartolake.plans import registry  # noqa: F401, I001  the queries that follow register themselves there
from cartolake.plans import captures  # noqa: F401
from cartolake.plans import catalogue, posts  # noqa: F401
