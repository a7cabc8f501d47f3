"""The library's queries bound to the given test tables."""
