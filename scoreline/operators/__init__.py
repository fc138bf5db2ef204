"""DataFrame -> DataFrame operators. Column names are arguments with the
reference's canonical names as defaults; none of them collects to the driver."""
