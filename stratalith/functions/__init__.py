"""Column functions: object identities, scalars, codecs."""
