"""DataFrame operators on order-book tables."""
