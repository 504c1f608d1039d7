"""Helpers shared by the tests."""


def table(df):
    return sorted(map(repr, map(tuple, df.collect())))
