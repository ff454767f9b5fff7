"""Graph operators over vertex and edge DataFrames."""
