"""What queries raise."""


class NoRows(LookupError):
    """first, single or last on a query without rows."""


class MoreThanOneRow(LookupError):
    """single on a query with several rows."""


class NotSupported(NotImplementedError):
    """An operator that strict mode rejects."""
