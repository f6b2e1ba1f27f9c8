"""Bar, option-chain and contract analytics for expired derivatives, on Spark."""
