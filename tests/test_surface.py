"""Every method and attribute that a user of such matrices, vectors, graphs, atoms and images calls is there."""

import pytest

from tesserae.api import AtomGraph, BlockGraph, BlockMatrix, ImageSet, MultiVector, Vector

NAMES = {
    BlockMatrix: "ndim nnz local_nnz global_nnz local_block_nnz shape matrix_kind transpose T transpose_ conjugate conj conj_ real imag __getitem__ __len__ create_serial create_distributed create_distributed_flat create_random from_scipy create_vector create_multivector add_block assemble get_block mult mult_adjoint mult_dense mult_dense_adjoint dot __matmul__ duplicate copy copy_from scale shift add_diagonal commutator_diagonal spmm spmm_self spmm_inplace spmm_hermitian spmm_hermitian_upper complete_hermitian square_polynomial_upper rarh_upper rhar_upper add axpy axpby filter_blocks get_block_density extract_submatrix extract_submatrix_batched insert_submatrix spmf to_dense from_dense row_ptr col_ind get_values to_scipy save_matrix_market fill fill_random zero_diagonal_blocks hermitize_diagonal_blocks frobenius_norm maxabs redistribute redistribute_cross shape_class_count page_size set_page_size pack_contiguous has_contiguous_layout vendor_backend_name vendor_launch_count reset_vendor_launch_count _matvec _matmat _rmatvec _rmatmat __add__ __sub__ __iadd__ __isub__ __mul__ __rmul__ __imul__ __truediv__ __neg__",
    Vector: "local_size ghost_size full_size shape size T duplicate copy copy_from to_numpy from_numpy __array__ set_constant set_random scale conjugate axpy axpby pointwise_mult dot __matmul__ sync_ghosts reduce_ghosts comm_seconds comm_calls reset_comm_stats __add__ __sub__ __mul__ __rmul__ __truediv__ __iadd__ __isub__ __imul__",
    MultiVector: "local_rows ghost_rows num_vectors shape size duplicate copy to_numpy from_numpy set_constant set_random scale axpy axpby pointwise_mult pointwise_mult_vec bdot dot get_col set_col swap sync_ghosts reduce_ghosts __radd__ __rsub__",
    BlockGraph: "construct_serial construct_distributed construct_distributed_flat owned_global_indices ghost_global_indices block_sizes adj_ptr adj_ind owned_scalar_rows local_scalar_cols global_scalar_rows global_scalar_cols get_local_index get_global_index rank size send_counts recv_counts send_counts_scalar recv_counts_scalar send_ranks recv_ranks",
    AtomGraph: "from_points from_graph_arrays from_distributed from_ase from_file positions pos atom_indices indices atom_types atomic_numbers z cell pbc n_atom edge_index edge_shift edge_vectors graph norb get_atom_norb volume to_ase get_graph3b get_atomicdata3b",
    ImageSet: "add_block add_blocks assemble get_block sample_k axpy_into redistribute_into accumulate_weighted_images",
}


@pytest.mark.parametrize("kind", NAMES, ids=lambda k: k.__name__)
def test_names(kind):
    assert not [n for n in NAMES[kind].split() if not hasattr(kind, n)]
