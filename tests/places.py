"""Where the driver's tables lie."""

SF = "/root/testdata/sf0.001"
