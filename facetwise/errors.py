"""What goes wrong, by kind."""


class FacetError(ValueError):
    pass


class SchemaError(FacetError):
    pass


class QueryError(FacetError):
    pass


class StaleSchemaError(FacetError):
    """A write made for another version of the schema."""
