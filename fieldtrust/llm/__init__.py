"""Operations for preparing text and vectors at corpus scale."""
