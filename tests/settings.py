"""Where the given tables lie."""

SF_DIR = "/root/testdata/sf0.001"
