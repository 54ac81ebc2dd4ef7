from . import catalogue, planted, service, tagging  # noqa: F401  their queries register themselves
from .registry import QUERIES, SQL  # noqa: F401
