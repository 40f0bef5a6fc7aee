"""DataFrame operators. Each is ``fn(df, ..., **opts) -> DataFrame``."""
