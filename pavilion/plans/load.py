"""Import every module that registers queries."""

import pavilion.plans.live  # noqa: F401
import pavilion.plans.pages  # noqa: F401
import pavilion.plans.statistics  # noqa: F401
import pavilion.plans.analysis  # noqa: F401
import pavilion.plans.intent  # noqa: F401
import pavilion.plans.ingest  # noqa: F401
import pavilion.plans.upkeep  # noqa: F401
import pavilion.plans.streams  # noqa: F401
import pavilion.plans.stored  # noqa: F401
