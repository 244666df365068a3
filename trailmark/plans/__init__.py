"""Plan building blocks that keep their shape when one key holds a large share of the rows."""

from trailmark.plans.lineage import cut
from trailmark.plans.lookups import attach
from trailmark.plans.ranking import global_rank_by_count
from trailmark.plans.sequences import GroupSizes, Scan, framed, measure, numbered, running, settle

__all__ = [
    "GroupSizes", "Scan", "attach", "cut", "framed", "global_rank_by_count", "measure", "numbered", "running", "settle",
]
