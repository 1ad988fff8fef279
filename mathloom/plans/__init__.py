"""Plan-level building blocks: skew-safe ranks and cuts, derived tables, registered queries."""
