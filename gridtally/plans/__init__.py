"""The analyses. Every public function is lazy: DataFrames in, DataFrame out.

The exceptions say so: quantiles and draws run small counting jobs up front.
"""
