"""All registered queries, gathered from the check modules."""

import checks.catalog  # noqa: F401
import checks.logs  # noqa: F401
import checks.pages  # noqa: F401
import checks.scoring  # noqa: F401
from checks.core import QUERIES, SQL  # noqa: F401
