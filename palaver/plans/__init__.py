"""Reports, the test-table views, the query catalog and its SQL counterparts."""
